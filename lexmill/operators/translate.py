"""Translation requests and replies: pending rows, budget, batches, replies, overrides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexmill import fixed
from lexmill.functions import text as tx
from lexmill.operators.batches import request_batches
from lexmill.operators.common import broadcast_if_small, cut_lineage, last_per_key, running_totals


def pending(rows: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    return rows if force else rows.join(cache, "entry_id", "left_anti")


def latest_records(records: DataFrame, key: str, order: Column) -> DataFrame:
    return last_per_key(records, [key], order)


def queue_level_rank(level) -> Column:
    table = tx.literal_map(fixed.QUEUE_LEVEL_ORDER)
    return F.coalesce(F.try_element_at(table, tx.as_col(level)), F.lit(fixed.QUEUE_OTHER_LEVEL))


def queue_keys(queue: DataFrame) -> DataFrame:
    """Repair queue with its order: level, gloss characters, word, id, as columns."""
    chars = F.aggregate("glosses", F.lit(0), lambda n, g: n + F.length(g))
    return queue.withColumns({"level_rank": queue_level_rank("level"), "chars": chars})


def queue_order(queue: DataFrame) -> DataFrame:
    """Repair queue by level, gloss characters, word."""
    return queue_keys(queue).orderBy("level_rank", "chars", "word", "id").drop("level_rank", "chars")


def text_batches(queue: DataFrame, max_texts: int = fixed.TEXT_BATCH_ROWS, max_chars: int = fixed.TEXT_BATCH_CHARS) -> DataFrame:
    """Repair queue packed by number of texts and characters, in the queue's order; rows without a text are left out."""
    texts = F.filter("glosses", lambda g: g != "")
    keyed = queue_keys(queue).withColumn("texts", F.size(texts)).where(F.col("texts") > 0)
    return request_batches(keyed, ["level_rank", "chars", "word", "id"], "chars", max_texts, max_chars, "texts")


def within_budget(rows: DataFrame, priority: str, size: str, order: list[str], budget: int = fixed.CHARACTER_BUDGET,
                  max_rows: int = 0) -> DataFrame:
    """Longest prefix of the priority order whose sizes sum to at most ``budget``.

    Priority is (``priority``, ``size``, ``order``...), unique at the end. Rows of
    size zero are left out; rows above the budget before the first pick are
    skipped, and any row that no longer fits ends the prefix.

    Rows with the same (priority, size) are interchangeable for the running
    sum, so it runs over their counts, dealt by range; only the one group in
    which the budget ends needs its rows in order. No window spans the rows.
    """
    rows = rows.where(F.col(size) > 0)
    groups = rows.groupBy(priority, size).agg(F.count("*").alias("n"))
    fits = groups.where(F.col(size) <= budget)
    start = fits.select(F.min(F.struct(priority, size)).alias("s")).scalar()
    first_large = (
        groups.where((F.col(size) > budget) & (F.struct(priority, size) > start))
        .select(F.min(F.struct(priority, size)).alias("s")).scalar()
    )
    head = fits.where(first_large.isNull() | (F.struct(priority, size) < first_large))
    summed = running_totals(head, [priority, size], {"spent": F.col(size) * F.col("n"), "seen": F.col("n")})
    cap = F.lit(max_rows if max_rows else 2**62)
    taken = summed.withColumn(
        "take", F.greatest(F.lit(0), F.least("n", F.floor((F.lit(budget) - F.col("spent")) / F.col(size)), cap - F.col("seen"))),
    ).select(priority, size, "n", "take")
    taken = cut_lineage(taken)
    # the first group that is not taken whole ends the prefix
    last = taken.where(F.col("take") < F.col("n")).select(F.min(F.struct(priority, size)).alias("s")).scalar()
    kept = taken.where((F.col("take") > 0) & (last.isNull() | (F.struct(priority, size) <= last)))
    marked = rows.join(broadcast_if_small(kept), [priority, size])
    whole = marked.where(F.col("take") == F.col("n")).drop("n", "take")
    partial = running_totals(marked.where(F.col("take") < F.col("n")), order, {"_rank": F.lit(1)})
    return whole.unionByName(partial.where(F.col("_rank") < F.col("take")).drop("n", "take", "_rank"))


def greedy_batches(rows: DataFrame, shard: Column, order: list[str], size: str, max_rows: int = fixed.BATCH_ROWS,
                   max_chars: int = fixed.BATCH_CHARS, count: str | None = None) -> DataFrame:
    """Pack rows into request batches, in order, within each shard.

    A batch closes when the next row would pass ``max_rows`` (or the sum of
    ``count`` would) or ``max_chars``. Closing depends on everything before it,
    so a shard is packed in one task: choose shards of a few thousand rows.
    One shard gives one sequence over all rows. Only the ordering keys and
    sizes go to Python.
    """
    keyed = rows.withColumn("shard", shard)
    narrow = keyed.select("shard", *order, F.col(size).cast("long").alias("_size"),
                          (F.col(count).cast("long") if count else F.lit(1).cast("long")).alias("_count"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if not f.name.startswith("_"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        ids, batch, held, used = [], 0, 0, 0
        for n, chars in zip(pdf["_count"], pdf["_size"]):
            if held and (held + n > max_rows or used + chars > max_chars):
                batch, held, used = batch + 1, 0, 0
            held, used = held + n, used + chars
            ids.append(batch)
        return pdf.drop(columns=["_size", "_count"]).assign(batch=pd.Series(ids, dtype="int64"))

    packed = narrow.groupBy("shard").applyInPandas(pack, f"{fields}, batch bigint")
    return keyed.join(packed, ["shard", *order])


def request_rows(entries: DataFrame, max_glosses: int = fixed.MAX_TRANSLATIONS) -> DataFrame:
    """Entries with glosses as JSON request items and their size."""
    item = F.to_json(
        F.struct(
            F.col("entry_id").alias("id"), F.col("headword").alias("word"), "reading", "level",
            F.col("major").alias("major_pos"), F.array_join("pos", fixed.LIST_SEPARATOR).alias("subpos"),
            F.slice("glosses", 1, max_glosses).alias("glosses"),
        )
    )
    return entries.where((F.col("entry_id") != "") & (F.size("glosses") > 0)).select(
        "entry_id", item.alias("item"), F.length(item).alias("item_chars"),
        F.aggregate("glosses", F.lit(0), lambda n, g: n + F.length(g)).alias("source_chars"),
    )


def request_sizes(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("rows"), F.sum("source_chars").alias("source_chars"), F.sum("item_chars").alias("request_chars")
    )


def parse_replies(replies: DataFrame, text_col: str = "content") -> DataFrame:
    """Reply texts to (keep columns..., entry_id, translation array).

    Fences are stripped and the outermost JSON is read in any of four shapes:
    a list, ``items``, ``translations``, or an object of id to value.
    """
    keep = [c for c in replies.columns if c != text_col]
    body = F.regexp_extract(tx.strip(text_col), r"(?s)^[^{\[]*([{\[].*[}\]])", 1)
    v = replies.select(*keep, F.try_parse_json(body).alias("v")).where(F.col("v").isNotNull())
    get = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    lists = F.coalesce(get("$", "array<variant>"), get("$.items", "array<variant>"), get("$.translations", "array<variant>"))
    pairs = F.map_entries(get("$", "map<string,variant>"))
    item = F.when(
        lists.isNotNull(),
        F.transform(
            lists,
            lambda x: F.struct(
                F.try_variant_get(x, "$.id", "string").alias("id"),
                F.array(F.try_variant_get(x, "$.translation", "variant"), F.try_variant_get(x, "$.translations", "variant")).alias("values"),
            ),
        ),
    ).otherwise(F.transform(pairs, lambda p: F.struct(p["key"].alias("id"), F.array(p["value"]).alias("values"))))
    rows = v.select(*keep, F.posexplode(item).alias("item_ord", "i")).select(*keep, "item_ord", "i.id", "i.values")
    # an empty or null first value gives way to the second one
    read = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    blank = lambda v: v.isNull() | F.call_function("is_variant_null", v) | (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("x")) == "") | (F.size(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.lit("x")))) == 0)
    value = F.when(~blank(F.get("values", 0)), read(F.get("values", 0))).otherwise(read(F.get("values", 1)))
    items = rows.select(
        *keep, "item_ord", tx.collapse(F.coalesce("id", F.lit(""))).alias("entry_id"), tx.translation_items(value).alias("translation")
    ).where((F.col("entry_id") != "") & (F.size("translation") > 0))
    return last_per_key(items, [*keep, "entry_id"], F.col("item_ord")).drop("item_ord")


def missing_replies(requested: DataFrame, parsed: DataFrame) -> DataFrame:
    return requested.join(parsed, "entry_id", "left_anti")


def align_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Texts answered by position, back to their rows.

    ``rows`` has batch, row_ord, entry_id, glosses; ``replies`` has batch and the
    array ``texts``. Each non-empty gloss has the ordinal it was sent with: the
    number of glosses sent before it in the same batch.
    """
    sent = F.filter("glosses", lambda g: g != "")
    w = W.partitionBy("batch").orderBy("row_ord")
    offset = F.sum(F.size(sent)).over(w) - F.size(sent)
    numbered = rows.withColumn("first", offset).select(
        "batch", "entry_id", F.posexplode(sent).alias("i", "gloss"), "first"
    ).select("batch", "entry_id", (F.col("first") + F.col("i")).alias("pos"), "i")
    texts = replies.select("batch", F.posexplode("texts").alias("pos", "text"))
    joined = numbered.join(texts, ["batch", "pos"]).withColumn("text", tx.compact_translation("text"))
    return joined.groupBy("entry_id").agg(
        F.array_join(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])), "；"
        ).alias("translation")
    )


def cache_overrides(rows: DataFrame, cache: DataFrame, source_label: str) -> DataFrame:
    """Override rows for the entries the cache covers."""
    label = F.coalesce(F.nullif(tx.collapse("source"), F.lit("")), F.lit(source_label))
    return rows.select("entry_id").join(
        cache.select("entry_id", F.array_join("translation", fixed.LIST_SEPARATOR).alias("translation"),
                     label.alias("translation_source")),
        "entry_id",
    )


def apply_overrides(lexicon: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace translation and source of the entries that have an override."""
    o = overrides.select("entry_id", F.col("translation").alias("_t"), F.col("translation_source").alias("_s"), F.lit(True).alias("updated"))
    joined = lexicon.join(o, "entry_id", "left")
    return joined.withColumns(
        {
            "translation": F.when(F.col("updated"), F.col("_t")).otherwise(F.col("translation")),
            "translation_source": F.when(F.col("updated"), F.col("_s")).otherwise(F.col("translation_source")),
            "updated": F.coalesce("updated", F.lit(False)),
        }
    ).drop("_t", "_s")


def upsert_audit(audit: DataFrame, updates: DataFrame) -> DataFrame:
    """Update amounts and notes by item; new items are added.

    A NULL in an update leaves the stored value. Sample rows repeat their item
    and are kept as they are.
    """
    u = updates.select("item", F.col("amount").alias("_a"), F.col("note").alias("_n"))
    return audit.join(u, "item", "full_outer").select(
        "item",
        F.coalesce("_a", "amount", F.lit("")).alias("amount"),
        F.coalesce("_n", "note", F.lit("")).alias("note"),
    )
