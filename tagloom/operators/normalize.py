"""Tag vocabulary normalization: counts, filters, lexical groups, mapping records.

Tables: *tag occurrences* hold one row per tag of a record (``sample_id, pos, tag``); a *mapping*
is ``(tag, canonical)``. The vocabulary is far smaller than the occurrences, so every step first
reduces occurrences to the vocabulary with a map-side partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tagloom.functions.lexical import lexical_key
from tagloom.functions.lookup import lookup_of
from tagloom.session import cut_lineage

MIN_TAG_COUNT = 20
LISTED_ROWS = 1 << 16  # that a task puts together at a time


def tag_occurrences(
    records: DataFrame, *, key: str = "sample_id", tags: str = "tags"
) -> DataFrame:
    """One row per tag of a record; ``pos`` keeps the order inside the record."""
    return records.select(F.col(key).alias("sample_id"), F.posexplode(tags).alias("pos", "tag"))


def tag_frequency(occurrences: DataFrame) -> DataFrame:
    """Count over all occurrences; repeats inside a record count."""
    return occurrences.groupBy("tag").agg(F.count("*").alias("n"))


def frequent_tags(frequency: DataFrame, min_count: int = MIN_TAG_COUNT) -> DataFrame:
    return frequency.filter(F.col("n") >= min_count)


def lexical_keys(tags: DataFrame) -> DataFrame:
    return tags.select("tag", lexical_key(F.col("tag")).alias("lexical_key"))


def rule_mapping(tags: DataFrame) -> DataFrame:
    """Tags with the same lexical key map to the smallest of them.

    The minimum per key is a partial aggregate joined back, not a window: a key that many tags
    share (all-punctuation tags, say) then never has to fit one task.
    """
    keyed = lexical_keys(tags)
    smallest = keyed.groupBy("lexical_key").agg(F.min("tag").alias("canonical"))
    return keyed.join(smallest, "lexical_key").select("tag", "canonical")


def compose(mapping: DataFrame, regroup: DataFrame) -> DataFrame:
    """Follow ``mapping`` and then ``regroup`` (``tag -> canonical`` over canonical tags)."""
    step = regroup.select(F.col("tag").alias("canonical"), F.col("canonical").alias("merged"))
    return mapping.join(step, "canonical", "left").select(
        "tag", F.coalesce("merged", "canonical").alias("canonical")
    )


def canonical_tags(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("canonical").alias("tag")).distinct()


def mapped_occurrences(occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct canonical tags per record with the place of their first occurrence.

    Tags outside the mapping are dropped. Counting per (record, tag) first keeps a record that
    repeats its tags small before its list is put together.
    """
    return (
        occurrences.join(mapping, "tag")
        .groupBy("sample_id", "canonical")
        .agg(F.min("pos").alias("pos"))
    )


def _records_of(ids: pa.Array) -> np.ndarray:
    """The number of the record of every row, counted from 0; NULL is a record like others."""
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.diff(code, prepend=code[:1]) != 0)


def _firsts(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows in order without the tags that a record had before, and the record of each."""
    rows = rows.combine_chunks()
    record = _records_of(pa.concat_arrays(rows.column("sample_id").chunks))
    tags = pa.concat_arrays(rows.column("canonical").chunks).dictionary_encode(null_encoding="encode")
    pair = record * len(tags.dictionary) + tags.indices.to_numpy()
    first = ~pd.Series(pair).duplicated().to_numpy()
    return rows.filter(pa.array(first)), record[first]


def _joined(rows: pa.Table, record: np.ndarray) -> pa.RecordBatch:
    """One row per record: its tags joined by commas."""
    opens = np.flatnonzero(np.diff(record, prepend=-1))
    tags = pa.concat_arrays(rows.column("canonical").chunks).cast(pa.large_string())
    known = tags.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.add.reduceat(known.astype(np.int64), opens)
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(ends, tags.drop_null()), pa.scalar(",", pa.large_string()))
    text = pc.if_else(pa.array(sizes > 0), text, None).cast(pa.string())
    ids = pa.concat_arrays(rows.column("sample_id").chunks).take(pa.array(opens))
    return pa.RecordBatch.from_arrays([ids, text], names=["sample_id", "tags"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of rows in order. The last one may go on in the next batch, so its tags wait."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < LISTED_ROWS:
            continue
        rows, record = _firsts(pa.Table.from_batches(held))
        last = int(np.searchsorted(record, record[-1]))
        if last:
            yield _joined(rows.slice(0, last), record[:last])
        held, n = rows.slice(last).to_batches(), 0
    if sum(batch.num_rows for batch in held):
        yield _joined(*_firsts(pa.Table.from_batches(held)))


def apply_mapping(occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cleaned tag string per record; records left without tags are dropped.

    Occurrences move once, to the task of their record, and are sorted there; lists are then made
    from runs of rows. Tags of a record hardly repeat, so counting them by (record, tag) first
    would only add a second shuffle. A record that does repeat its tags is read by one task, which
    holds each of them once. ``sample_id`` is of a plain type.
    """
    key = occurrences.schema["sample_id"].dataType
    rows = occurrences.join(mapping, "tag").select("sample_id", "pos", "canonical")
    return (
        rows.repartition("sample_id")
        .sortWithinPartitions("sample_id", "pos", "canonical")
        .select("sample_id", "canonical")
        .mapInArrow(_lists, StructType([StructField("sample_id", key), StructField("tags", StringType())]))
    )


def numbered_records(records: DataFrame) -> DataFrame:
    """Records with a row identity of their own in ``_row``: keys may be repeated or NULL.

    They are written once, so that a task that is run again can't number them anew.
    """
    return cut_lineage(records.withColumn("_row", F.monotonically_increasing_id()))


def record_cleaner(
    mapping: DataFrame, *, tags: str = "tags"
) -> Callable[[DataFrame], DataFrame]:
    """``clean_records`` with its mapping measured once, for many tables or micro-batches."""
    lookup = lookup_of(mapping, "tag", F.col("canonical"), "string")

    def in_row(records: DataFrame) -> DataFrame:
        mapped = F.filter(F.transform(tags, lookup.get), lambda tag: tag.isNotNull())
        cleaned = F.array_join(F.array_distinct(mapped), ",")
        return records.filter(F.size(mapped) > 0).withColumn(tags, cleaned)

    def joined(records: DataFrame) -> DataFrame:
        numbered = numbered_records(records)
        cleaned = apply_mapping(tag_occurrences(numbered, key="_row", tags=tags), mapping)
        cleaned = cleaned.select(F.col("sample_id").alias("_row"), F.col("tags").alias("_tags"))
        return (
            numbered.join(cleaned, "_row").withColumn(tags, F.col("_tags")).select(*records.columns)
        )

    return joined if lookup is None else in_row


def clean_records(records: DataFrame, mapping: DataFrame, *, tags: str = "tags") -> DataFrame:
    """Records with their tags mapped, repeats dropped, joined by commas; records left without
    tags are dropped.

    With a mapping small enough for a lookup this is row work on the list and nothing is
    shuffled. Otherwise the occurrences are joined to the mapping and the result to the records,
    row by row: repeated and NULL keys give the same rows either way.
    """
    return record_cleaner(mapping, tags=tags)(records)


def top_tags(occurrences: DataFrame, mapping: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent canonical tags over cleaned records."""
    counts = mapped_occurrences(occurrences, mapping).groupBy("canonical").agg(
        F.count("*").alias("n")
    )
    return counts.orderBy(F.desc("n"), "canonical").limit(k)


def normalization_stats(occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: vocabulary before and after, ratio, records and tags kept."""
    before = occurrences.agg(F.count_distinct("tag").alias("n")).scalar()
    per_record = (
        mapped_occurrences(occurrences, mapping)
        .groupBy("sample_id")
        .agg(F.count("*").alias("kept"))
    )
    totals = per_record.agg(
        F.struct(
            F.count("*").alias("records"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_tags")
        ).alias("totals")
    )
    return (
        mapping.agg(
            F.count("*").alias("filtered_tags"),
            F.count_distinct("canonical").alias("final_tags"),
        )
        .withColumn("original_tags", before)
        .withColumn(
            "ratio_pct", F.round(F.try_divide(F.col("final_tags") * 100.0, "filtered_tags"), 1)
        )
        .withColumn("totals", totals.scalar())
        .select("*", "totals.*")
        .drop("totals")
    )


def reduction_steps(occurrences: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """Distinct tags left after each step; ``steps`` maps a step name to its mapping."""
    rows = occurrences.agg(F.count_distinct("tag").alias("tags")).select(
        F.lit(0).alias("step"), F.lit("original").alias("name"), "tags"
    )
    for i, (name, mapping) in enumerate(steps.items(), 1):
        left = mapping.agg(F.count_distinct("canonical").alias("tags"))
        rows = rows.unionByName(left.select(F.lit(i).alias("step"), F.lit(name).alias("name"), "tags"))
    return rows
