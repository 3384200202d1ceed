"""Tokens of TypeScript, JavaScript, Java and Go, each with its place in the file's structure.

A token knows the bracket, statement, argument and block it stands in, so that definitions, calls, assignments and returns are
filters and joins over token rows.  Texts and comments never yield names; expressions inside template texts do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Languages with tokens.
LANGUAGES = ["typescript", "javascript", "java", "go"]
TOKENS = """path string, lang string, k int, line int, kind string, text string, name string, before string, after string, up int, part int, stmt int, call int, arg int, eq int, ret boolean,
lo int, hi int, loop int, mate int, head int, chain int, assigned string, names array<string>, declares boolean, weak boolean"""


def _structure(lang: str, text: str) -> Iterator[tuple]:
    """Rows of ``TOKENS`` without path and language, in order; brackets that never close end with the file."""
    import re

    script, go = lang in ("typescript", "javascript"), lang == "go"
    # Words that are no names of values or calls.
    words = set(
        "if else for while do switch case default return break continue new class interface enum import package throw throws try catch finally const let var function async await yield typeof instanceof in of delete void "
        "public private protected static final abstract synchronized extends implements func type struct map chan go defer select range fallthrough goto export from as true false null undefined nil".split()
    )
    name = r"[A-Za-z_$][\w$]*"
    chain = rf"(?:\s*\??\.\s*{name})*"
    generic = r"[A-Z]\w*<[\w\s,.?&\[\]<>]*>|" if lang == "java" else ""
    raw = r"`[^`]*`?|" if go else r'"""(?:[^"\\]|\\.|"(?!""))*(?:""")?|' if lang == "java" else ""
    code = re.compile(
        rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<nl>\n)|(?P<s>{raw}\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<n>{generic}\??\.\s*{name}{chain}|{name}{chain})"
        r"|(?P<d>\d[\w.]*)|(?P<o>=>|:=|={2,3}|[!<>]=+|[-+*/%&|^?]{1,2}=(?!=)|&&|\|\||\?\?|\.{3}|[^\s\w])",
        re.S,
    )
    chunk = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
    pattern = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
    goes_on = re.compile(r"\s*(?:[.?:+*/%&|^=<>,)\]{-]|instanceof\b|in\b|of\b)")
    rows: list[dict] = []
    # a frame is an open bracket: what it is, and the state of the statement in it
    top = {"k": -1, "kind": "block", "part": 0, "stmt": -1, "call": -1, "arg": 0, "eq": -1, "ret": False, "block": -1, "loop": -1, "parens": [], "arrows": [], "assigned": None, "from": 0}
    frames, at, line, ends = [top], 0, 1, {-1: 2**31 - 1}

    def end_part(f: dict) -> None:
        for a in f["arrows"]:
            rows[a]["mate"] = len(rows) - 1
        f["arrows"], f["assigned"], f["from"] = [], None, len(rows)

    def end_statement(f: dict) -> None:
        end_part(f)
        if f["kind"] == "block":
            f.update(part=0, stmt=-1, eq=-1, ret=False, parens=[])

    def add(kind: str, word: str) -> dict:
        f, k = frames[-1], len(rows)
        if f["kind"] == "block" and f["stmt"] < 0:
            f.update(stmt=k, ret=word == "return")
        arg = f["part"] if f["kind"] == "call" else f["arg"]
        row = {
            "k": k, "line": line, "kind": kind, "text": word, "name": None, "before": rows[-1]["text"] if rows else "", "after": "", "up": f["k"], "part": f["part"], "stmt": f["stmt"], "call": f["call"], "arg": arg,
            "eq": f["eq"], "ret": f["ret"], "block": f["block"], "loop": f["loop"], "mate": -1, "head": -1, "chain": -1, "assigned": f["assigned"], "names": None, "declares": False, "weak": False,
        }
        if rows:
            rows[-1]["after"] = word
        rows.append(row)
        return row

    def assign(f: dict, row: dict) -> None:
        """The names that the part of the statement before this token assigns."""
        k, first = row["k"], rows[f["stmt"]]["text"] if f["stmt"] >= 0 else ""
        last = rows[k - 1] if k else None
        if last is None:
            return
        own = [r for r in rows[f["from"] : k] if r["kind"] == "name" and r["up"] == f["k"] and r["text"] not in words]
        if script and last["text"] in ("}", "]") and last["mate"] >= 0 and rows[last["mate"]]["before"] in ("const", "let", "var", "(", ",", ";", ""):
            names = [r["text"] for r in rows[last["mate"] : k] if r["kind"] == "name" and r["after"] != ":"]
        elif go:
            names = [r["text"] for r in own]
        elif script and first in ("const", "let", "var", "export", "for") and own:
            names = [own[0]["text"]]
        else:
            names = [last["text"]] if last["kind"] == "name" else [r["text"] for r in own[:1]]
        typed = lang == "java" and k > 1 and (rows[k - 2]["kind"] == "name" and rows[k - 2]["text"] not in ("return", "else") or rows[k - 2]["text"] in ("]", ">"))
        row.update(names=names, declares=first in ("const", "let", "var", "export") or row["text"] in (":=", "of") or row["before"] in ("const", "let") or typed, weak=len(row["text"]) == 2 and row["text"] not in (":=", "of"), kind="assign")
        f.update(eq=k, assigned=names[0] if names else None)

    def opened(word: str, kind: str, row: dict) -> None:
        f = frames[-1]
        block = kind == "block"
        loop = f["loop"] if f["loop"] >= 0 or not block or f["stmt"] < 0 or rows[f["stmt"]]["text"] not in ("for", "while", "do") else row["k"]
        frames.append({
            "k": row["k"], "kind": kind, "part": 0, "stmt": -1 if block else f["stmt"], "call": row["k"] if kind == "call" else -1 if block else f["call"], "arg": 0 if block or kind == "call" else row["arg"], "eq": -1 if block else f["eq"],
            "ret": False if block else f["ret"], "block": row["k"] if block else f["block"], "loop": loop, "parens": [], "arrows": [], "assigned": None, "from": len(rows),
        })

    def closed(word: str) -> None:
        end_part(frames[-1])
        f = frames.pop() if len(frames) > 1 else None
        row = add("close", word)
        if f is None:
            return
        row["mate"], rows[f["k"]]["mate"] = f["k"], row["k"]
        if f["kind"] == "block":
            ends[f["k"]] = row["k"]
            if frames[-1]["kind"] == "block":
                end_statement(frames[-1])
        elif word == ")":
            frames[-1]["parens"].append(f["k"])

    def header(f: dict) -> int:
        """The bracket of parameters that a body belongs to: in Go the first after a name, else the last."""
        if go:
            named = [p for p in f["parens"] if rows[p]["before"] not in words]
            return (named or f["parens"] or [-1])[0]
        return f["parens"][-1] if f["parens"] else -1

    while at < len(text):
        prev = rows[-1] if rows else None
        if script and text[at] == "`" or frames[-1]["kind"] == "hole" and text[at] == "}":
            if text[at] == "}":
                closed("}")
            found = chunk.match(text, at + 1)
            add("text", text[at : found.end()])
            line += text.count("\n", at, found.end())
            at = found.end()
            if text.startswith("${", at):
                row = add("open", "${")
                opened("${", "hole", row)
                at += 2
            else:
                at += 1
            continue
        if script and text[at] == "/" and (prev is None or prev["kind"] in ("open", "op", "assign") or prev["text"] in ("return", "typeof", "case")):
            found = pattern.match(text, at)
            if found:
                add("text", found.group())
                at = found.end()
                continue
        found = code.match(text, at)
        if not found:
            at += 1
            continue
        kind, word, f = found.lastgroup, found.group(), frames[-1]
        at = found.end()
        if kind == "nl":
            whole = prev is not None and (prev["kind"] in ("text", "number", "close") or prev["kind"] == "name" and (prev["text"] not in words or prev["text"] in ("return", "break", "continue", "true", "false", "null", "nil")))
            if (go or script) and f["kind"] == "block" and whole and f["stmt"] >= 0 and not (script and goes_on.match(text, at)):
                end_statement(f)
            elif go and f["kind"] == "group" and whole:
                end_part(f)
            line += 1
        elif kind == "c":
            line += word.count("\n")
        elif kind == "s":
            add("text", word)
            line += word.count("\n")
        elif kind == "d":
            add("number", word)
        elif kind == "n":
            said = "".join(word.split()).replace("?.", ".")
            back = rows[prev["mate"]] if prev and prev["text"] == ")" and prev["mate"] >= 0 and said.startswith(".") else None
            row = add("name", said)
            if back is not None:
                maker = rows[back["k"] - 1] if back["k"] else None
                if maker is not None and maker["kind"] == "name" and maker["name"]:
                    row["name"] = (maker["name"] + "()" + said)[-200:]
                    if not text[at:].lstrip()[:1] == "(":
                        row["name"] = None
                    else:
                        maker["chain"] = row["k"] + 1
            elif said not in words:
                row["name"] = "new " + said if row["before"] == "new" else said
            if said == "of" and rows[f["stmt"]]["text"] == "for" if f["stmt"] >= 0 else False:
                assign(f, row)
            line += word.count("\n")
        elif word in "([{":
            called = word == "(" and prev is not None and prev["kind"] == "name" and prev["name"] is not None
            first = rows[f["stmt"]]["text"] if f["stmt"] >= 0 else ""
            literal = word == "{" and prev is not None and (
                prev["text"] in ("(", ",", "=", ":", "[", "return", "?", "||", "&&", "??", "...", "const", "let", "var", "in", "of") and not (prev["text"] == ":" and f["kind"] == "block" and first in ("case", "default"))
                or go and (prev["kind"] == "name" or prev["text"] in ("]", "}")) and first not in ("if", "for", "switch", "func", "type", "else", "select") and f["kind"] != "block"
                or go and f["kind"] == "block" and f["eq"] >= 0 and prev["kind"] == "name" and first not in ("if", "for", "switch")
                or lang == "java" and prev["text"] == "]"
            )
            arrow = prev["head"] if prev is not None and prev["text"] == "=>" else -1
            row = add("open", word)
            if word == "{" and not literal:
                if prev is not None and prev["text"] == "=>":
                    row["head"], row["kind"] = arrow, "body"
                    rows[prev["k"]]["kind"] = "op"
                    f["arrows"] = [a for a in f["arrows"] if a != prev["k"]]
                else:
                    row["head"] = header(f)
                    row["kind"] = "body" if row["head"] >= 0 else "open"
            opened(word, "call" if called else "block" if word == "{" and not literal else "group", row)
        elif word in ")]}":
            closed(word)
        elif word == "=>":
            row = add("arrow", word)
            row["head"] = prev["mate"] if prev and prev["text"] == ")" else f["parens"][-1] if f["parens"] and prev and prev["text"] != ")" and (prev["before"] == ":" or prev["text"] == ">") else prev["k"] if prev else -1
            f["arrows"].append(row["k"])
        elif word == ";":
            add("op", word)
            end_statement(f)
        elif word == ",":
            add("op", word)
            if not (go and f["kind"] == "block"):
                end_part(f)
                f["part"] += 1
                if f["kind"] == "block":
                    f["eq"] = -1
        else:
            row = add("op", word)
            java_each = lang == "java" and word == ":" and f["kind"] == "group" and f["stmt"] >= 0 and rows[f["stmt"]]["text"] == "for"
            if java_each or word == ":=" or word[-1] == "=" and word not in ("==", "===", "!=", "!==", "<=", ">="):
                if f["kind"] != "call":
                    assign(f, row)
    while len(frames) > 1:
        end_part(frames.pop())
    end_part(top)
    for r in rows:
        r["lo"], r["hi"] = r["block"], ends.get(r.pop("block"), 2**31 - 1)
        if r["mate"] < 0 and r["kind"] in ("body", "open", "arrow"):
            r["mate"] = len(rows) - 1
        if r["kind"] in ("name", "open", "body", "arrow", "assign", "text"):
            yield r


def tokens(files: DataFrame) -> DataFrame:
    """Rows of ``TOKENS`` of a ``SOURCE_FILES`` table's files in ``LANGUAGES``; closing brackets, numbers and operators are left out.

    ``name``: the dotted name of a value or of what is called, with the calls before it; ``call, arg``: the innermost call that a token is an argument of;
    ``eq``: the assignment it is assigned by; ``lo, hi``: its block; ``mate``: where a bracket or an arrow's expression ends; ``head``: the parameters of a body.
    Null texts have none, repeated files count once; texts that do not follow the grammar have tokens all the same.  A file is held whole by one task.
    """
    structure, fields = _structure, [c.split()[0] for c in TOKENS.replace("\n", " ").split(", ")]

    def work(batches):
        import pandas as pd

        for batch in batches:
            for path, lang, text in zip(batch["path"], batch["lang"], batch["text"]):
                rows = list(structure(lang, text))
                for start in range(0, len(rows), 20000):
                    part = rows[start : start + 20000]
                    yield pd.DataFrame({"path": path, "lang": lang} | {c: [r[c] for r in part] for c in fields[2:]})

    asked = files.where(files["lang"].isin(*LANGUAGES) & files["text"].isNotNull()).select("path", "lang", "text")
    # repeated files go before they are tokens, which are many times their size; a given number of tasks, as Spark would judge by the size of the texts
    asked = asked.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").distinct()
    return asked.mapInPandas(work, TOKENS)
