"""How queries are registered: a Spark side and, where SQL can say it, the text that another engine answers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.dialect import translate
from tidemill.sources.tables import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]
NAMES = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", re.I)


def run_sql(spark: SparkSession, sf_dir: str, text: str, args: list | None = None) -> DataFrame:
    """text in the engine's dialect over the tables of sf_dir, without touching the session's catalog."""
    found: dict[str, DataFrame] = {}

    def named(m: re.Match) -> str:
        name = m[2].lower()
        found[name] = load(spark, sf_dir, name)
        after = text[m.end() :].lstrip()
        own = "" if re.match(r"(?i)(AS\s+)?(?!WHERE|JOIN|ON|GROUP|ORDER|LEFT|RIGHT|FULL|CROSS|INNER|LIMIT|USING|HAVING|UNION|SEMI|ANTI|OFFSET)[a-z_]\w*", after) else f" AS {name}"
        return f"{m[1]} {{{name}}}{own}"

    sql = NAMES.sub(named, text)
    sql, values = translate(sql, args)
    return spark.sql(sql, args=values or None, **found)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query whose text both engines take; oracle: the other engine's own text where the dialects differ."""
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
        self.oracle[name] = oracle or text

    def frame(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Registers a function over DataFrames."""

        def add(f: Query) -> Query:
            self.queries[name] = f
            if oracle:
                self.oracle[name] = oracle
            return f

        return add
