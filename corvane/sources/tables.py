"""Sources and sinks: arrivals, copies, merges, imports, value lists, handles, label sets, manifests."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.review import in_force
from corvane.operators.sets import numbered
from corvane.plans.storage import fresh_path, small_or_shuffled


def arrivals(seen: DataFrame, now: DataFrame, path: str = "path", again: bool = False) -> DataFrame:
    """(path, state) of files: new, changed (size or time differ), unchanged, vanished; quarantined ones stay so unless asked again."""
    old = seen.select(path, F.col("size").alias("__s"), F.col("mtime").alias("__m"), F.col("status").alias("__st"))
    both = old.join(now, path, "full_outer")
    same = (F.col("__s") == F.col("size")) & (F.col("__m") == F.col("mtime"))
    held = (F.col("__st") == "quarantined") & F.lit(not again)
    state = F.when(F.col("__s").isNull(), "new").when(F.col("size").isNull(), "vanished").when(held, "quarantined").when(same, "unchanged").otherwise("changed")
    return both.select(path, state.alias("state"))


def copies(files: DataFrame, identity: Sequence[str], first_seen: str, path: str) -> DataFrame:
    """Files with is_copy: all but the first seen of an identity are further locations of it."""
    first = files.groupBy(*identity).agg(F.min(F.struct(first_seen, path)).alias("__f"))
    return files.join(first, list(identity)).withColumn("is_copy", F.col("__f")[path] != F.col(path)).drop("__f")


def merged_rows(files: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Many files describe one row: nulls are filled, a disagreement keeps the least text; and the disagreements."""
    g = files.groupBy(key).agg(*[F.min(F.col(c).cast("string")).alias(c) for c in columns], *[F.countDistinct(c).alias(f"__n_{c}") for c in columns])
    wrong = g.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__n_{c}").alias("values")) for c in columns]))).filter("values > 1")
    return g.select(key, *columns), wrong


@dataclass(frozen=True)
class Import:
    """How a CSV file maps to rows: columns {target: (source, type, format)}, the natural key, and what to do with existing rows."""

    columns: Mapping[str, tuple[str, str, str | None]]
    key: Sequence[str]
    existing: str = "skip"  # skip, update or supersede


def parsed(raw: DataFrame, spec: Import) -> DataFrame:
    """Typed columns and a refusal reason; dates are read only under their declared form."""
    out, reason = [], F.lit(None).cast("string")
    for name, (source, kind, form) in spec.columns.items():
        text = F.nullif(F.trim(F.col(source).cast("string")), F.lit(""))
        value = F.try_to_timestamp(text, F.lit(form)).cast("date") if kind == "date" else text.try_cast(kind)
        out.append(value.alias(name))
        reason = F.coalesce(reason, F.when(text.isNotNull() & value.isNull(), F.lit(f"bad {name}")))
    for k in spec.key:
        reason = F.coalesce(reason, F.when(F.nullif(F.trim(F.col(spec.columns[k][0]).cast("string")), F.lit("")).isNull(), F.lit(f"no {k}")))
    return raw.select(*out, reason.alias("refused"))


def preview(rows: DataFrame, table: DataFrame, spec: Import) -> DataFrame:
    """Each parsed row with what an import would do: inserted, skipped, updated or superseded, refused, unchanged."""
    values = [c for c in spec.columns if c not in spec.key]
    old = table.select(*spec.key, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__held"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in values], F.lit(True))
    action = F.when(F.col("refused").isNotNull(), "refused").when(F.col("__held").isNull(), "inserted").when(same, "unchanged").otherwise({"skip": "skipped", "update": "updated", "supersede": "superseded"}[spec.existing])
    return rows.join(old, list(spec.key), "left").withColumn("action", action).drop("__held", *[f"__{c}" for c in values])


def imported(rows: DataFrame, table: DataFrame, spec: Import) -> DataFrame:
    """The table after the import; running it twice changes nothing more."""
    p = preview(rows, table, spec)
    fresh = p.filter("action in ('inserted', 'updated', 'superseded')").select(*spec.columns)
    if spec.existing == "skip":
        return table.select(*spec.columns).unionByName(fresh)
    return table.select(*spec.columns).join(fresh.select(*spec.key), list(spec.key), "left_anti").unionByName(fresh)


def checked_events(events: DataFrame, kinds: DataFrame) -> DataFrame:
    """Events with a refusal reason by their kind's vocabulary: unknown kind, or a number out of its range."""
    v = small_or_shuffled(kinds.select(F.col("kind"), F.col("lo"), F.col("hi"), F.lit(True).alias("__k")))
    reason = F.when(F.col("__k").isNull(), "unknown kind").when(F.col("number") < F.col("lo"), "below").when(F.col("number") > F.col("hi"), "above")
    return events.join(v, "kind", "left").withColumn("refused", reason).drop("__k", "lo", "hi")


def resolved(values: DataFrame, table: DataFrame, value: str, key: str) -> tuple[DataFrame, DataFrame]:
    """A list of (position, value) to keys, and the positions that no row answers."""
    hits = values.join(table.select(F.col(value).alias("value"), F.col(key)), "value", "left")
    return hits.filter(F.col(key).isNotNull()).select("position", "value", key), hits.filter(F.col(key).isNull()).select("position", "value")


def selection(wanted: DataFrame, grains: Mapping[str, tuple[DataFrame, str, str]], subject: str) -> tuple[DataFrame, DataFrame]:
    """Distinct subjects of a list of (grain, ref) over several grains, and the items that were not found."""
    hits = [wanted.filter(F.col("grain") == g).join(df.select(F.col(key).cast("string").alias("ref"), F.col(subj).alias(subject)), "ref", "left").select("grain", "ref", subject) for g, (df, key, subj) in grains.items()]
    all_ = reduce(lambda a, b: a.unionByName(b), hits)
    return all_.filter(F.col(subject).isNotNull()).select(subject).distinct(), all_.filter(F.col(subject).isNull()).select("grain", "ref").distinct()


def freeze(df: DataFrame, key: str, page_rows: int = 1000, epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """A frozen answer in the shared folder, in key order with _position (from 0) and _page; and its handle: columns, rows, pages, epoch and content hash."""
    numbers = numbered(df, [key], "_position").withColumn("_position", F.col("_position") - 1)
    paged = numbers.withColumn("_page", F.floor(F.col("_position") / page_rows).cast("long"))
    path = fresh_path(df.sparkSession, "handle")
    paged.repartitionByRange("_position").sortWithinPartitions("_position").write.parquet(path)
    kept = df.sparkSession.read.schema(paged.schema).parquet(path)
    pages = F.ceil(F.col("rows") / page_rows).cast("long")
    handle = content_hash(kept.select(*df.columns)).select(F.lit(",".join(df.columns)).alias("columns"), "rows", pages.alias("pages"), F.lit(epoch).cast("long").alias("epoch"), "hash")
    return kept, handle


def canonical(df: DataFrame) -> Column:
    """A row as text: doubles to 9 digits, nulls marked, columns by name."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_string("%.9f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("~"))
    return F.concat_ws("|", *[cell(c) for c in sorted(df.columns)])


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free content hash of an answer: the digest of the row count and the sums of two slices of its rows' digests."""
    row = F.sha2(canonical(df), 256)
    slice_ = lambda a: F.sum(F.conv(F.substring(row, a, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.coalesce(slice_(1), F.lit(0)), F.coalesce(slice_(9), F.lit(0))), 256).alias("hash"))


class Selections:
    """Saved, versioned questions by name; one may use others, up to eight deep."""

    def __init__(self):
        self._saved: dict[tuple[str, int], object] = {}

    def save(self, name: str, build) -> int:
        version = 1 + max((v for n, v in self._saved if n == name), default=0)
        self._saved[name, version] = build
        return version

    def run(self, name: str, version: int | None = None, depth: int = 0) -> DataFrame:
        if depth > 8:
            raise ValueError(f"{name}: selections nest more than eight deep")
        version = version or max(v for n, v in self._saved if n == name)
        return self._saved[name, version](lambda other, v=None: self.run(other, v, depth + 1))


def label_set(decisions: DataFrame, unit: str, axis: str, order: Sequence[str], sealed: DataFrame | None = None, training: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labels in canonical order for a TSV file, and their digest: the decision in force of each unit and axis.

    The training variant leaves out sealed units and labels that were not made blind (column blind).
    """
    rows = in_force(decisions, unit, axis)
    if training:
        blind = decisions.filter("blind").select("decision_id")
        rows = rows.join(blind, "decision_id", "left_semi")
        rows = rows if sealed is None else rows.join(sealed.select(unit), unit, "left_anti")
    return rows.orderBy(*order), content_hash(rows)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


def measures(runs: DataFrame, unit: str, version: str, run: str, names: Sequence[str]) -> DataFrame:
    """Wide result tables to (unit, name, number): the newest run of each unit in the current version."""
    current = runs.agg(F.max(version).alias(version))
    newest = Window.partitionBy(unit).orderBy(F.desc(run))
    rows = runs.join(F.broadcast(current), version).withColumn("__r", F.row_number().over(newest)).filter("__r = 1")
    return rows.select(F.col(unit), *[F.col(n).cast("double").alias(n) for n in names]).unpivot([unit], list(names), "name", "number").filter("number is not null")


def breaches(measures_: DataFrame, checks: DataFrame) -> DataFrame:
    """Numbers outside their declared range."""
    return measures_.join(small_or_shuffled(checks), "name").filter((F.col("number") < F.col("lo")) | (F.col("number") > F.col("hi"))).drop("lo", "hi")


def manifest(df: DataFrame, keys: Sequence[str], **counts: Column) -> DataFrame:
    """One row per participant, session or scan of a dataset."""
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in counts.items()])


def manifests(scans: DataFrame, subject: str, session: str, scan: str) -> dict[str, DataFrame]:
    """The three manifests of a dataset: participants with their sessions and scans, sessions with their scans, and scans."""
    n = {"scans": F.countDistinct(scan)}
    return {"participants": manifest(scans, [subject], sessions=F.countDistinct(session), **n), "sessions": manifest(scans, [subject, session], **n), "scans": scans.select(subject, session, scan).distinct()}


def write_manifests(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_tsv(df, f"{folder}/{name}.tsv")


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "", text)


def vote_matrix(df: DataFrame, unit: str, clauses: Mapping[str, str | Column]) -> DataFrame:
    """Every vote as a long table (unit, rule, value): what each clause says of each unit, null where it is silent.  A unit's rows come out of one row."""
    told = F.array(*[F.struct(F.lit(name).alias("rule"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value")) for name, c in clauses.items()])
    return df.select(unit, F.inline(told))
