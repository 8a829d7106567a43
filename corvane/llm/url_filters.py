"""URL filters by a sort-merge range join.

A host is written back to front, each label closed by a dot (``en.example.com`` is ``com.example.en.``), so that a rule's host
and all its subdomains are one interval of keys. Both sides are cut at the same sampled splitters; in each range the urls and
the interval starts are sorted and swept once. Rules are prefixes, hence nested, so the rules that hold at a key are a stack:
a rule is pushed at its interval's start and popped at its end. The innermost one whose path fits decides.

Urls are ordered by (key, path, hash of the row), so a host or url with a third of all rows is split over many ranges. A rule
goes to the ranges that its interval touches; wide rules are few, since a rule is only as wide as its host is short.

Cases: a null url or one without ``://`` has an empty host and path and no rule; ports and user names stay part of the host;
repeated rows are judged each; an empty table or no rules give the default verdict; input columns named like a result are
replaced; rules with equal host and path resolve to the action that sorts first.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm.common import without

#: Urls in one range, about; ranges are held by one task at a time.
RANGE_ROWS = 50_000
#: Ranges at least, and rows sampled per range and at most to choose the splitters.
LEAST_RANGES, SAMPLE, MOST_SAMPLED = 16, 16, 2_000_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?`` or ``#``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels back to front, each followed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _spread_key(key: Column, path: Column, row: Column) -> Column:
    # the separator is the lowest code point, so the order is that of (key, path, row)
    return F.concat_ws("\x00", key, path, F.lpad(F.hex(row), 16, "0"))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules`` has ``action``, ``rule_host``, ``rule_path``. The rule with the longest host that fits wins, then the longest path.
    """
    spark = df.sparkSession
    rows = without(df, ["host", "path", "rule", "verdict", "_range", "_key", "_spread"])
    host, path = host_path(F.col(url))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("_key", host_key(F.col("host")))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.select(url, *[c for c, t in df.dtypes if t in ("bigint", "int")]).dtypes])
    spread = _spread_key(F.col("_key"), F.col("path"), hashed)

    total = rows.count()
    ranges = min(max(LEAST_RANGES, -(-total // range_rows)), MOST_SAMPLED // SAMPLE)
    # a bounded sample chooses the splitters; they only decide balance
    sample = rows.select(spread.alias("k")).sample(min(1.0, 1.0 * SAMPLE * ranges / max(total, 1)), seed=7)
    points = sorted(r[0] for r in sample.collect())
    splitters = sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else []

    def number(batches):
        for b in batches:
            at = [bisect.bisect_right(splitters, k) for k in b.column("_spread").to_pylist()]
            yield b.drop_columns(["_spread"]).append_column("_range", pa.array(at, pa.int32()))

    ranged_schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])
    ranged = rows.withColumn("_spread", spread).mapInArrow(number, ranged_schema)

    def reach(batches):
        for b in batches:
            out: dict[str, list] = {"_range": [], "_low": [], "_action": [], "_host": [], "_path": []}
            for action, rule_host, rule_path, low in zip(*[b.column(c).to_pylist() for c in ("action", "rule_host", "rule_path", "_low")]):
                first, last = bisect.bisect_right(splitters, low), bisect.bisect_right(splitters, low + "\U0010ffff")
                for k in range(first, last + 1):
                    for column, value in zip(out.values(), (k, low, action, rule_host, rule_path)):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_range", pa.int32()), *[(c, pa.string()) for c in list(out)[1:]]]))

    spans = rules.withColumn("_low", host_key(F.col("rule_host"))).select("action", "rule_host", "rule_path", "_low").dropna(
        subset=["rule_host", "rule_path"]).mapInArrow(reach, "_range int, _low string, _action string, _host string, _path string")

    out_schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_key"], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    names = [f.name for f in out_schema]
    empty = to_arrow_schema(out_schema).empty_table()

    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        starts = [] if not right.num_rows else sorted(zip(*[right.column(c).to_pylist() for c in ("_low", "_path", "_action", "_host")]))
        keys, paths = left.column("_key").to_pylist(), left.column("path").to_pylist()
        chosen: list[str | None] = [None] * len(keys)
        verdicts = [default] * len(keys)
        stack: list[tuple[str, list]] = []  # (interval's key, its rules by path length)
        nxt = 0
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            k = keys[i]
            while nxt < len(starts) and starts[nxt][0] <= k:
                low = starts[nxt][0]
                here = []
                while nxt < len(starts) and starts[nxt][0] == low:
                    here.append(starts[nxt][1:])
                    nxt += 1
                while stack and not low.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((low, sorted(here, key=lambda r: (-len(r[0]), r))))
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            for _, here in reversed(stack):
                fit = next((r for r in here if paths[i].startswith(r[0])), None)
                if fit:
                    chosen[i], verdicts[i] = fit[2] + fit[0], fit[1]
                    break
        out = left.select([n for n in names if n not in ("rule", "verdict")])
        return out.append_column("rule", pa.array(chosen, pa.string())).append_column("verdict", pa.array(verdicts, pa.string()))

    return ranged.groupBy("_range").cogroup(spans.groupBy("_range")).applyInArrow(sweep, out_schema)
