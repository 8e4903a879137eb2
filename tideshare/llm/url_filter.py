"""Prefix rules on addresses as a sort-merge range join."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import batch, tasks

#: Addresses that are looked at for the splitters, per range, about.
SAMPLE_PER_RANGE = 20
#: Bytes of addresses in one range, about.
RANGE_BYTES = 16 << 20
#: Ends a label in a key, and the character after it.
END, AFTER = "\x01", "\x02"


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(rest_of(url), "/", 1)).otherwise(F.lit(""))
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(F.coalesce(cut, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rest_of(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + F.lit(3))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    cut = F.substring_index(F.substring_index(rest_of(url), "?", 1), "#", 1)
    return F.when((F.instr(url, "://") > 0) & (F.instr(cut, "/") > 0), F.substr(cut, F.instr(cut, "/"))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the right, each ended by a control character that no label keeps: it is spelled in two there.

    The keys of a host and all its subdomains start with its key, and no others do: a rule is the interval
    from its key to the key with the character after the last end.
    """
    spelled = F.replace(F.replace(host, F.lit(AFTER), F.lit(AFTER + "\x03")), F.lit(END), F.lit(AFTER + "\x04"))
    return F.concat(F.array_join(F.reverse(F.split(spelled, r"\.")), END), F.lit(END))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id",
               url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path of the
    address starts with that of the rule; the longest rule (host plus path) wins, of equally long
    ones the deeper host. An address without a rule gets ``default``.

    Only a sample of addresses, some per range, goes to the driver. Reversed-host keys are range-partitioned by sampled splitters over (key, path, identifier),
    so a hot host spreads over tasks. A rule goes to each range that its interval touches. In a
    range, addresses and rules are swept in key order, with a stack of the rules whose interval is
    open: nested hosts, each with its sorted paths. Null or odd addresses have empty host
    and path and fall under the default; a rule that is repeated counts once, with the smaller verdict
    in order of letters where they differ; rules with null in a column are left out.
    """
    spark = pages.sparkSession
    host, path = host_of(F.col(url_column)), path_of(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    tie = F.hex(F.xxhash64("page_id"))
    place = F.concat_ws("\x01", F.concat(F.col("key"), F.lit("\x00")), "path", tie)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("path")), F.lit(0))).first()
    ranges = max(tasks(spark), -(-size // RANGE_BYTES))
    # a share of the rows by hash, so that the driver gets as many as the ranges need, whatever the table holds
    share = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 30))
    looked = rows.filter(share < F.lit(max(1, (SAMPLE_PER_RANGE * ranges << 30) // max(n, 1)))).select(place.alias("place"))
    sample = sorted(r["place"] for r in looked.collect())
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def dealt(column: str) -> Iterator:
        at = pa.schema([("range", pa.int32()), ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("key", pa.string())])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                where = [bisect_right(splitters, p) for p in b.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(b.column(n) for n in at.names[1:])], schema=at)

        return go

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
        for b in batches:
            out: list[tuple] = []
            for key, *rest in zip(*(b.column(n).to_pylist() for n in schema.names[1:]), strict=True):
                first, last = bisect_right(splitters, key), bisect_left(splitters, key[:-1] + AFTER)
                out += [(r, key, *rest) for r in range(first, last + 1)]
            yield batch(schema, *(list(zip(*out, strict=True)) or [[]] * 5))

    page_rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("place", place).mapInArrow(
        dealt("place"), "range int, page_id long, host string, path string, key string")
    once = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule_rows = once.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict").mapInArrow(
        spread, "range int, key string, host string, path string, verdict string")

    def sweep(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        own = sorted(zip(*(right.column(n).to_pylist() for n in ("key", "path", "host", "verdict")), strict=True))
        todo, stack = 0, []  # stack: (key, host, {path: verdict}, lengths of its paths from the longest)
        for key, path, host, page in sorted(zip(*(left.column(n).to_pylist() for n in ("key", "path", "host")),
                                                range(left.num_rows), strict=True)):
            while todo < len(own) and own[todo][0] <= key:
                at = own[todo][0]
                while stack and not at.startswith(stack[-1][0]):
                    stack.pop()
                paths: dict[str, str] = {}
                while todo < len(own) and own[todo][0] == at:
                    paths[own[todo][1]], name = own[todo][3], own[todo][2]
                    todo += 1
                stack.append((at, name, paths, sorted({len(p) for p in paths}, reverse=True)))
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = (-1, "", default)
            for _, name, paths, lengths in reversed(stack):  # the deepest host first
                for n in lengths:
                    if n + len(name) <= best[0]:
                        break
                    if (found := paths.get(path[:n]) if len(path) >= n else None) is not None:
                        best = (n + len(name), name + path[:n], found)
                        break
            out["page_id"].append(page)
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(best[1] if best[0] >= 0 else None)
            out["verdict"].append(best[2])
        numbers = left.column("page_id").take(pa.array(out.pop("page_id"), pa.int64()))
        return pa.table([numbers, *(pa.array(v, pa.string()) for v in out.values())], names=["page_id", *out])

    return page_rows.groupBy("range").cogroup(rule_rows.groupBy("range")).applyInArrow(
        sweep, "page_id long, host string, path string, rule string, verdict string")
