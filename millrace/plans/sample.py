"""A small project in several languages, for queries that need source code."""

FILES = {
    "shop/__init__.py": "from .orders import place\n__all__ = ['place']\n",
    "shop/orders.py": '''
import json
import os
import subprocess
from flask import request
from shop.base import Step


def place(cursor, rush=False, extras=[]):
    name = request.args.get("name")
    cursor.execute(f"insert into orders values ('{name}')")
    if rush and extras or name:
        for extra in extras:
            subprocess.run(extra, shell=True)
    return priced(len(extras))


def priced(n):
    return n * rate()


def rate():
    return 1.2


def forgotten():
    return helper_of_forgotten()


def helper_of_forgotten():
    return os.getcwd()


class Pack(Step):
    def run_step(self):
        return self.weight()

    def weight(self):
        return 3

    def never_called(self):
        return 4


class Unused:
    def method(self):
        try:
            return 5
        except:
            pass
''',
    "shop/base.py": "class Step:\n    def run_step(self):\n        raise NotImplementedError\n\n\ndef drive(step: Step):\n    return step.run_step()\n",
    "shop/__main__.py": "from shop.base import drive\nfrom shop.orders import Pack\n\ndrive(Pack())\n",
    "tests/test_orders.py": "from shop.orders import rate\n\n\ndef test_rate():\n    assert rate() == 1.2\n",
    "web/src/index.ts": "import { show } from './view'\nshow()\n",
    "web/src/view.ts": "export function show() { document.body.innerHTML = location.hash }\nexport const spare = 1\n",
    "web/src/old.ts": "export const gone = 1\n",
    ".github/workflows/ci.yml": "on: pull_request_target\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n      - run: curl http://example.org/x.sh | sh\n",
    "Dockerfile": "FROM python\nADD https://example.org/x.tgz /x\nENV API_TOKEN=abcdef\n",
}

#: What the analysis must report: file to line to rules, without their common prefix.
EXPECTED = {
    ".": {1: "R101 R102 R104 R105"},
    ".github/workflows/ci.yml": {1: "D291 D307", 5: "D292", 6: "D328"},
    "Dockerfile": {2: "D342", 3: "D343"},
    "shop/base.py": {1: "Q802", 2: "T102", 6: "T102"},
    "shop/orders.py": {1: "Q802", 2: "U002", 9: "L001 T101 T102", 11: "D211", 14: "D209 D212", 18: "T101 T102", 22: "T102", 26: "T102 U001", 30: "T102 U001", 35: "T102", 38: "T102", 41: "T102 U001", 45: "U004", 46: "T102", 49: "L002 L007"},
    "tests/test_orders.py": {4: "T102"},
    "web/src/old.ts": {1: "E003"},
    "web/src/view.ts": {1: "D226 E004"},
}
