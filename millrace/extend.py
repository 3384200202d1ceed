"""What users add to an analysis: rules over facts, visitors of syntax trees, checks of model calls, words of dictionaries.

Everything added is data or a function; nothing is looked up by name on executors, as functions travel by value.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.operators.score import defense_score
from millrace.sources.frames import frames
from millrace.sources.python_facts import COLUMNS, SCHEMA

#: A rule takes the table of facts and gives findings (columns of ``rules.COLUMNS``).
Rule = Callable[[DataFrame], DataFrame]
#: A visitor takes a node and the path of its file and gives ``(kind, name, attrs)`` for every fact it sees.
Visitor = Callable[[ast.AST, str], Iterable[tuple[str, str, dict]]]


@dataclass
class Extensions:
    """Rules, visitors, checks (``plugin, severity, category, SQL condition over the evidence of a call``) and words (``list, word, rule, severity``)."""

    rules: list[Rule] = field(default_factory=list)
    visitors: list[Visitor] = field(default_factory=list)
    checks: list[tuple[str, str, str, str]] = field(default_factory=list)
    words: list[tuple[str, str, str, str]] = field(default_factory=list)

    def facts(self, files: DataFrame) -> DataFrame:
        """Facts that the visitors see in Python files, in the shape of all facts."""
        visitors = self.visitors

        def seen(path: str, module: str, text: str) -> Iterator[tuple]:
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError):
                return  # listed as incomplete by the extraction itself
            for node in ast.walk(tree):
                for visit in visitors:
                    for kind, name, attrs in visit(node, path):
                        line = getattr(node, "lineno", 1)
                        yield (kind, path, module, name, None, line, getattr(node, "end_lineno", line), {}, {k: str(v) for k, v in attrs.items()}, [])

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from frames((r for p, m, t in zip(batch["path"], batch["module"], batch["text"], strict=True) for r in seen(p, m, t)), COLUMNS)

        return files.where("lang = 'python'").select("path", "module", "text").mapInPandas(walk, SCHEMA)

    def findings(self, facts: DataFrame) -> DataFrame:
        """Findings of all added rules, and of added words: calls by that name (list ``calls``), decorators, or keywords that are off (list ``switches``)."""
        found = [rule(facts).select(*rules.COLUMNS) for rule in self.rules]
        for where, word, rule, severity in self.words:
            if where == "switches":
                hit = facts.where(F.col("kind") == "call").where(F.col("attrs")[f"kw:{word}"] == "False")
            else:
                hit = facts.where(F.col("kind") == where.rstrip("s")).where(F.col("name") == word)
            found.append(rules.as_findings(hit, rule, severity, "custom", rules.say("%s is on the list", "name")))
        return rules.union_all(found) if found else rules.as_findings(facts.limit(0), "", "", "custom", F.lit(""))

    def posture(self, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results of the added checks for every model call (``evidence``: one row a call), and their score."""
        rows = F.array(*[F.struct(F.lit(n).alias("plugin"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.expr(e).alias("passed")) for n, s, c, e in self.checks])
        results = evidence.select("*", F.explode(rows).alias("x")).select(*evidence.columns, "x.*")
        return results, defense_score(results.withColumn("scope", F.lit("project")), ["scope"])
