"""One statement for two engines.

A query is written once, in the SQL that Spark and the DuckDB oracle share, with upper-case macros where
their functions differ.  Relations are named queries of their own; a statement gets those that it uses
as common table expressions, and driver tables as Parquet paths.  Nothing is registered in the session,
so statements over different folders don't meet, and Catalyst sees one plan from scan to result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Macro: its text for Spark and for the oracle.  Arguments are separated by ``;``.
MACROS: dict[str, tuple[str, str]] = {
    "EPOCH": ("(unix_micros(cast({0} AS timestamp)) div 1000000)", "(epoch_us({0}) // 1000000)"),
    "IDIV": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "JSON_TEXT": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "MATCHES": ("rlike({0}, r{1})", "regexp_matches({0}, {1})"),
    "GROUP_OF": ("regexp_extract({0}, r{1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "REPLACED": ("regexp_replace({0}, r{1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "JOINED": ("listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})", "string_agg({0}, {1} ORDER BY {2})"),
    "PERCENTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "BYTES": ("octet_length({0})", "strlen({0})"),
    "DATE_TEXT": ("date_format(timestamp_seconds({0}), 'yyyy-MM-dd')", "strftime(make_timestamp(({0}) * 1000000), '%Y-%m-%d')"),
    "ASCII_LOWER": ("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",) * 2,
    "PADDED": ("lpad(cast({0} AS string), {1}, '0')", "lpad(cast({0} AS varchar), {1}, '0')"),
    "TEXT": ("cast({0} AS string)", "cast({0} AS varchar)"),
    "NUMBER": ("try_cast({0} AS bigint)",) * 2,
    "SUM_INT": ("cast(sum({0}) AS bigint)",) * 2,
    "COUNT_IF": ("count_if({0})", "cast(count_if({0}) AS bigint)"),
    "WHOLE": ("cast(floor({0}) AS bigint)",) * 2,
    "SORTED_SET": ("array_join(array_sort(collect_set({0})), ',')", "array_to_string(list_sort(list_distinct(list({0}))), ',')"),
}


_CALL = re.compile(rf"\b({'|'.join(sorted(MACROS, key=len, reverse=True))})\[")


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of the macro whose bracket opens before ``at``, and where it ends; quoted text is passed over."""
    out, start, depth, quoted = [], at, 0, False
    for k in range(at, len(sql)):
        c = sql[k]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif c == "]":
            return [*out, sql[start:k].strip()], k + 1
        elif c == ";" and not depth:
            out.append(sql[start:k].strip())
            start = k + 1
    raise ValueError(f"no end of a macro: {sql[at - 20 : at + 60]}")


def _expand(sql: str, engine: int) -> str:
    """Macros, outer ones first and their arguments after."""
    out, at = [], 0
    while m := _CALL.search(sql, at):
        arguments, end = _arguments(sql, m.end())
        if m[1] in ("MATCHES", "GROUP_OF", "REPLACED") and "''" in arguments[1]:
            raise ValueError(f"a quote in a pattern is written \\x27: {arguments[1]}")
        out += [sql[at : m.start()], MACROS[m[1]][engine].format(*[_expand(a, engine) for a in arguments])]
        at = end
    return "".join([*out, sql[at:]])


class Relations:
    """Named relations; a definition may be one text or a pair for the two engines."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[str, str]] = {}

    def add(self, name: str, sql: str, oracle: str | None = None) -> None:
        self.of[name] = (sql, oracle or sql)

    def needed(self, sql: str, engine: int, done: dict[str, str] | None = None) -> dict[str, str]:
        done = {} if done is None else done
        for name in dict.fromkeys(re.findall(r"\b[a-z_]+\b", sql)):
            if name in self.of and name not in done:
                text = self.of[name][engine]
                inner = {name: text}
                self.needed(text, engine, seen := {**done, **inner})
                seen.pop(name)
                done |= seen
                done[name] = text
        return done

    def statement(self, sql: str, engine: int) -> str:
        ctes = self.needed(sql, engine)
        recursive = "RECURSIVE " if engine == 1 and "RECURSIVE" in sql else ""
        body = sql.replace("RECURSIVE", "")
        own = body.strip()
        if ctes:
            heads = ", ".join(f"{n} AS ({t})" for n, t in ctes.items())
            own = f"WITH {recursive}{heads}" + (", " + own[4:].strip() if own.upper().startswith("WITH") else " " + own)
        elif recursive:
            own = own.replace("WITH", "WITH RECURSIVE", 1)
        return _expand(own, engine)


RELATIONS = Relations()


def spark_query(sql: str, relations: Relations = RELATIONS) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = relations.statement(sql, 0)
        for name in TABLES:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b(?!\s*\()", rf"\1 parquet.`{sf_dir}/{name}.parquet` AS {name}", text)
        # A table that has an alias of its own keeps that one.
        text = re.sub(r"(\.parquet`) AS \w+(\s+AS\s+\w+|\s+(?!ON\b|JOIN\b|LEFT\b|WHERE\b|GROUP\b|ORDER\b|LATERAL\b|UNION\b|USING\b|CROSS\b|HAVING\b|LIMIT\b|INNER\b|SEMI\b|ANTI\b)[a-z]\w*\b)", r"\1\2", text)
        return spark.sql(text)

    return run


def oracle_query(sql: str, relations: Relations = RELATIONS) -> str:
    return relations.statement(sql, 1)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame, for operators that are not statements."""
    return spark_query(f"SELECT * FROM {name}")(spark, sf_dir)


def relation_over(spark: SparkSession, name: str, **written: str) -> DataFrame:
    """A relation over others that were written as tables, by their paths, so that what several relations share is made once."""
    text = _expand(RELATIONS.of[name][0], 0)
    for other, path in written.items():
        text = re.sub(rf"\b(FROM|JOIN)\s+{other}\b", rf"\1 parquet.`{path}` AS {other}", text)
    return spark.sql(text)
