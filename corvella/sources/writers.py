"""Writers: idempotent appends, replacement of a run or of edges, flat exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; a job's files appear together when it commits."""
    rows.write.mode("append" if append else "overwrite").json(path)


def csv_value(column: str, kind: str) -> Column:
    """How a value is told in a CSV: arrays joined by ;, structs and maps as JSON, booleans in lower case."""
    c = F.col(column)
    if kind.startswith("array<struct") or kind.startswith(("struct", "map")):
        return F.to_json(c)
    if kind.startswith("array"):
        return F.array_join(c.cast("array<string>"), ";")
    return c.cast("string")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*(csv_value(n, k).alias(n) for n, k in rows.dtypes)).write.mode("overwrite").csv(path, header=True)


def append_new(rows: DataFrame, existing: DataFrame, key: list[str], path: str) -> None:
    """Append rows whose key isn't there yet, each key once."""
    rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti").write.mode("append").parquet(path)


def replace_partition(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Replace just the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def replaced_edges(existing: DataFrame, new: DataFrame, a: str, b: str, ids: DataFrame) -> DataFrame:
    """Edges less those with either end among `ids`, and the new ones."""
    key = ids.columns[0]
    kept = existing.join(ids.withColumnRenamed(key, a), a, "left_anti").join(ids.withColumnRenamed(key, b), b, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def flatten(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Nested structs as columns named by their paths."""
    while any(k.startswith("struct") for _, k in rows.dtypes):
        cols: list[Column] = []
        for field in rows.schema.fields:
            if field.dataType.typeName() == "struct":
                cols += [F.col(f"`{field.name}`.`{x.name}`").alias(f"{field.name}_{x.name}") for x in field.dataType.fields]
            else:
                cols.append(F.col(f"`{field.name}`"))
        rows = rows.select(*cols)
    return rows


def pairwise_scores(decisions: DataFrame) -> DataFrame:
    """A row for each pair of voters; decisions without pairs give none."""
    return decisions.select("pmcid", "chunk_id", F.explode("pairwise_scores").alias("p")).select("pmcid", "chunk_id", "p.*")


def document_text(elements: DataFrame, by_path: bool = False) -> DataFrame:
    """One text a document, its elements in order of place or of path."""
    order = F.struct("path", "pos", "text") if by_path else F.struct("pos", "path", "text")
    return elements.groupBy("pmcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "\n").alias("text"))


def write_by_concept(rows: DataFrame, path: str, concept: str) -> None:
    """A folder for each concept."""
    rows.repartition(concept).write.mode("overwrite").partitionBy(concept).json(path)


def manifest(counts: DataFrame, config: dict, most_keys: int = 10_000) -> str:
    """A run's manifest: sums by key and a digest of its configuration (K15, K16, T24); an error if there are more than `most_keys` keys."""
    import hashlib

    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"))
    rows = counts.groupBy("key").agg(F.sum("n").alias("n")).limit(most_keys + 1).collect()
    if len(rows) > most_keys:
        raise ValueError(f"a manifest has at most {most_keys} keys")
    sums = {r["key"]: r["n"] for r in rows}
    return json.dumps({"config_sha256": hashlib.sha256(canonical.encode()).hexdigest(), "counts": sums}, sort_keys=True)


def merge_manifests(old: dict, new: dict) -> dict:
    """Later values win; mappings merge key by key."""
    return {**old, **{k: merge_manifests(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}}


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table (K17); a report shows `most` rows, and says so if there are more."""
    head = rows.limit(most + 1).collect()
    more, head = len(head) > most, head[:most]
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head] + [""] * more + [f"The first {most} rows."] * more) + "\n"


def schema_drift(rows: DataFrame, expected: dict[str, str], unique: list[list[str]]) -> list[str]:
    """Missing columns, wrong types and keys that repeat."""
    have = dict(rows.dtypes)
    out = [f"missing column {c}" for c in expected if c not in have] + [f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    for key in unique:
        if set(key) <= set(have) and not rows.groupBy(*key).count().where("count > 1").isEmpty():
            out.append(f"{', '.join(key)} repeats")
    return out
