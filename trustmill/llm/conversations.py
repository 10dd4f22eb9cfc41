"""Repair of the turn structure of conversations by a fold of edits over their rows.

Each row may be kept, given the role user or assistant, or deleted, and empty turns may be inserted anywhere; the roles
left must read `(s?(ua)+)?` by their initials. Windows and aggregates mark the faults of rows; sorted structs of a
block of rows are then folded by aggregate(), whose state is four (cost, audit) structs: the cheapest edits so far
that leave nothing, a system turn, a user turn or an assistant turn as the last one. Each step takes the least of the
ways into a state, so ties end at the audit that is first by its letters.

A conversation may have any number of rows. Blocks of BLOCK rows are folded from each of the four states, and FAN
blocks at a time are then joined to one, until one is left; so no row gathers more than that many of them. The digest
of a repaired conversation is taken row by row over sorted partitions, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm.common import table
from trustmill.operators.prefix import running_before

BLOCK, FAN = 256, 64
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
#: What the last turn left is: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Edits as the fold writes them: their initials, but I and R into an assistant are J and S, which sort alike.
INNER, OUTER = "JS", "IR"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), some of them dropped, emptied, stripped of their ends of sentences, repeated or
    given the role user, by a checksum of id and turn. Null roles and texts become one space, as do null ids and turns
    in the checksum."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_fate")
    return own.withColumn("_", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fate", "_")


def _entry(cost: Column | int, audit: Column) -> Column:
    return F.struct((F.lit(cost) if isinstance(cost, int) else cost).cast("long").alias("cost"), audit.alias("audit"))


def _then(entry: Column, cost: Column | int, letter: Column | str) -> Column:
    """An entry and one more edit."""
    return _entry(entry["cost"] + cost, F.concat(entry["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _with_inserts(state: Column) -> list[Column]:
    """The four entries, or the cheaper way there by inserted turns."""
    e, s, u, a = (F.get(state, i) for i in range(4))
    u = F.least(u, *[_then(x, INSERT, "I") for x in (e, s, a)])
    return [e, s, u, F.least(a, _then(u, INSERT, "J"))]


def _step(state: Column, row: Column) -> Column:
    """The four entries after one more row (initial, doomed, truncated)."""
    e, s, u, a = _with_inserts(state)
    own = F.when(row["doomed"], NEVER).when(row["truncated"], TRUNCATED).otherwise(0)
    stays = lambda letter: own + F.when(row["initial"] == letter, 0).otherwise(REROLE)
    user, assistant = (F.when(row["initial"] == "u", "K").otherwise("R"), F.when(row["initial"] == "a", "K").otherwise("S"))
    return F.array(
        _then(e, DELETE, "D"),
        F.least(_then(s, DELETE, "D"), _then(e, F.when(row["initial"] == "s", own).otherwise(NEVER), "K")),
        F.least(_then(u, DELETE, "D"), *[_then(x, stays("u"), user) for x in (e, s, a)]),
        F.least(_then(a, DELETE, "D"), _then(u, stays("a"), assistant)),
    )


def _begun(start: int, audit: Column) -> Column:
    return F.array(*[_entry(0 if i == start else NEVER, audit) for i in range(4)])


def _from_each(first: Column, fold) -> Column:
    """fold(start) for every state that the block may start in: of a conversation's first block, only NONE."""
    return F.when(first, F.array(fold(NONE))).otherwise(F.array(*[fold(s) for s in range(4)]))


def _joined(state: Column, block: Column) -> Column:
    """The four entries after one more block, each audit an array of one string a block."""
    never = _entry(NEVER, F.array().cast("array<string>"))
    way = lambda m, e: F.coalesce(F.get(F.get(block, m), e), never)
    through = lambda m, e: _entry(F.get(state, m)["cost"] + way(m, e)["cost"], F.concat(F.get(state, m)["audit"], way(m, e)["audit"]))
    return F.array(*[F.least(*[through(m, e) for m in range(4)]) for e in range(4)])


def cheapest_edits(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, cost, slices, tail) from rows (conv_id, pos, initial, doomed, truncated), pos counting from 0 in each
    conversation: the edits of each block of rows, and the turns inserted after the last one, in INNER letters."""
    own = rows.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", "doomed", "truncated"))).alias("rows"))
    one = lambda s: F.aggregate("rows", _begun(s, F.lit("")), _step, lambda x: F.transform(x, lambda y: _entry(y["cost"], F.array(y["audit"]))))
    parts = saved(own.select("conv_id", "block", _from_each(F.col("block") == 0, one).alias("ways")))
    last = parts.agg(F.max("block")).first()[0] or 0
    while last:
        held = parts.groupBy("conv_id", F.floor(F.col("block") / fan).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "ways"))).alias("blocks"))
        more = lambda s: F.aggregate("blocks", _begun(s, F.array().cast("array<string>")), lambda x, b: _joined(x, b["ways"]))
        parts = saved(held.select("conv_id", "block", _from_each(F.col("block") == 0, more).alias("ways")))
        last //= fan
    ended = F.aggregate(F.array(F.lit(0)), F.transform(F.get("ways", 0), lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("slices"))), lambda x, _: x)
    # what is left must be nothing or end with an assistant; inserted turns count after the last row too
    e, s, u, a = (F.get(ended, i) for i in range(4))
    end = lambda x, cost, tail: F.struct((x["cost"] + cost).alias("cost"), x["slices"].alias("slices"), F.lit(tail).alias("tail"))
    best = F.least(end(e, 0, ""), end(a, 0, ""), end(u, INSERT, "J"), end(s, 2 * INSERT, "IJ"))
    return parts.select("conv_id", best.alias("_best")).select("conv_id", "_best.*")


def _sha256_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) from sorted (conv_id, lines), a conversation's rows one after the other."""
    at, digest = None, None

    def ended(schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], schema.field("conv_id").type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        rows = zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True)
        for conv, lines in groupby(rows, key=lambda x: x[0]):
            if digest is not None and conv != at:
                yield ended(batch.schema)
                digest = None
            for _, text in lines:
                if digest is None:
                    at, digest = conv, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
        schema = batch.schema
    if digest is not None:
        yield ended(schema)


def repaired(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations given as rows (conv_id, turn, role, text), without nulls in role and text.

    report has a row for each conversation: gaps in its turns, rows that are blank, duplicate (role and text seen
    before) or truncated (no end of a sentence) by their first fault, illegal neighbours, and the cost and audit of the
    cheapest edits. turns is (conv_id, pos, lines): the repaired `role:text` lines of each row that leaves any,
    turns inserted before it included, and those after the last row.

    Rows are taken by turn, null turns first; those of one turn by role, then by a digest of the text. Rows may repeat,
    and are then duplicates; a null conv_id is a conversation of its own. Texts may be of any length; other columns are
    ignored; an empty table gives empty ones.
    """
    # repeated rows have nothing to tell them apart by but a number, which is saved with them
    own = saved(rows.select("conv_id", "turn", "role", "text").withColumn("_id", F.monotonically_increasing_id()))
    ended = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = own.select("_id", "conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), (ended == "").alias("blank"), (~ended.isin(".", "!", "?")).alias("open"))
    first = slim.where("NOT blank").groupBy("conv_id", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "_id")).alias("x")).select(F.col("x._id").alias("_id"), F.lit(True).alias("_first"))
    flagged = slim.join(first, "_id", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    flagged = flagged.select("_id", "conv_id", "turn", "role", "sha", F.substring("role", 1, 1).alias("initial"), "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("open")).alias("truncated"), F.lit(1).cast("long").alias("_one"))
    placed = saved(running_before(flagged, ["conv_id"], ["turn", "role", "sha", "_id"], {"pos": "_one"}).drop("sha", "_one", "role"))

    # neighbours inside blocks by a window over each block, those across by one over the blocks
    where = placed.withColumn("block", F.floor(F.col("pos") / block))
    legal = lambda before: F.concat(before, F.col("initial")).isin("su", "ua", "au")
    inside = where.withColumn("_before", F.lag("initial").over(Window.partitionBy("conv_id", "block").orderBy("pos")))
    counted = inside.groupBy("conv_id", "block").agg(
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.when(F.col("_before").isNotNull() & ~legal(F.col("_before")), 1).otherwise(0)).alias("illegal"),
        F.min_by("initial", "pos").alias("initial"), F.max_by("initial", "pos").alias("_last"),
    )
    counted = counted.withColumn("_before", F.lag("_last").over(Window.partitionBy("conv_id").orderBy("block")))
    counts = counted.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.when(F.col("_before").isNotNull() & ~legal(F.col("_before")), 1).otherwise(0)).alias("illegal"),
    )
    gaps = placed.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))

    edits = saved(cheapest_edits(placed.select("conv_id", "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("doomed"), "truncated"), block, fan))
    audit = F.translate(F.concat(F.array_join("slices", ""), "tail"), INNER, OUTER)
    same = lambda df: F.col("conv_id").eqNullSafe(df["_conv"])
    named = lambda df: df.withColumnRenamed("conv_id", "_conv")
    report = counts
    for part in (named(gaps), named(edits.select("conv_id", "cost", audit.alias("audit")))):
        report = report.join(part, same(part)).drop("_conv")

    sliced = edits.select(F.col("conv_id").alias("_conv"), F.posexplode("slices").alias("_block", "_slice")).where(F.length(F.translate("_slice", "D", "")) > 0)
    kept = where.join(sliced, same(sliced) & (F.col("block") == F.col("_block")))
    each = F.regexp_extract_all("_slice", F.lit("([IJ]*[DKRS])"), 1)
    kept = kept.select("_id", "conv_id", "pos", F.get(each, (F.col("pos") - block * F.col("block")).cast("int")).alias("edits")).where("edits <> 'D'")
    line = lambda c: F.when(c == "I", "user:").when(c == "J", "assistant:").when(c == "R", F.concat(F.lit("user:"), "text")).when(c == "S", F.concat(F.lit("assistant:"), "text")).when(c == "K", F.concat("role", F.lit(":"), "text"))
    lines = F.array_join(F.transform(F.filter(F.split("edits", ""), lambda c: c != ""), line), "\n")
    turns = kept.join(own.select("_id", "role", "text"), "_id").select("conv_id", "pos", lines.alias("lines"))
    after = edits.where("tail <> ''").select("conv_id", F.lit(NEVER).alias("pos"), F.when(F.col("tail") == "J", "assistant:").otherwise("user:\nassistant:").alias("lines"))
    return report, turns.unionByName(after)


def sha256_by_conversation(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns (conv_id, pos, lines), joined by line feeds in order of pos. A conversation's
    rows meet in one task, as a digest asks, but are read one by one."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "lines").mapInArrow(_sha256_of_lines, f"conv_id {kind}, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conv_id of `conversations`: faults after the damage, the cheapest edits, and the digest of what they
    leave. Null ids are one conversation. Of one whose rows are all dropped, all counts are 0, and audit and text
    empty; so is the result of an empty table. Repeated rows are duplicates; other columns are ignored."""
    rows = table(spark, sf_dir, "conversations")
    report, turns = repaired(damaged(rows))
    ids = rows.select("conv_id").distinct()
    for part in (report.withColumnRenamed("conv_id", "_conv"), sha256_by_conversation(turns).withColumnRenamed("conv_id", "_conv")):
        ids = ids.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS id,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS f FROM keyed),
rows AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, id, copy,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM fated, (VALUES (0), (1)) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), id, copy) AS pos, substr(role, 1, 1) AS i,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), id, copy) AS j,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS whole,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) > 1 AS again FROM rows),
d AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND NOT whole AS trunc FROM marked),
fold AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, {'c': 0::BIGINT, 'a': '', 't': ''} AS e, {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS s,
    {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS u, {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS a FROM d
  UNION ALL
  SELECT conv_id, pos, {'c': e.c + 2, 'a': e.a || 'D', 't': e.t},
    list_min([{'c': s.c + 2, 'a': s.a || 'D', 't': s.t}, {'c': e.c + CASE i WHEN 's' THEN own ELSE 1000000000000 END, 'a': e.a || 'K', 't': e.t || nl(e.t) || line}]),
    list_min([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}, {'c': e.c + toU, 'a': e.a || kU, 't': e.t || nl(e.t) || lineU}, {'c': s.c + toU, 'a': s.a || kU, 't': s.t || nl(s.t) || lineU}, {'c': a.c + toU, 'a': a.a || kU, 't': a.t || nl(a.t) || lineU}]),
    list_min([{'c': a.c + 2, 'a': a.a || 'D', 't': a.t}, {'c': u.c + toA, 'a': u.a || kA, 't': u.t || nl(u.t) || lineA}])
  FROM (
    SELECT conv_id, pos, i, own, line, e, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || nl(u.t) || 'assistant:'}]) AS a,
      own + CASE i WHEN 'u' THEN 0 ELSE 1 END AS toU, own + CASE i WHEN 'a' THEN 0 ELSE 1 END AS toA, CASE i WHEN 'u' THEN 'K' ELSE 'R' END AS kU, CASE i WHEN 'a' THEN 'K' ELSE 'R' END AS kA,
      CASE i WHEN 'u' THEN line ELSE 'user:' || text END AS lineU, CASE i WHEN 'a' THEN line ELSE 'assistant:' || text END AS lineA
    FROM (
      SELECT d.conv_id, d.pos, d.i, d.text, d.role || ':' || d.text AS line, CASE WHEN blank OR dup THEN 1000000000000 WHEN trunc THEN 5 ELSE 0 END AS own, e, s, a,
        list_min([u, {'c': e.c + 5, 'a': e.a || 'I', 't': e.t || nl(e.t) || 'user:'}, {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || nl(s.t) || 'user:'}, {'c': a.c + 5, 'a': a.a || 'I', 't': a.t || nl(a.t) || 'user:'}]) AS u
      FROM fold JOIN d ON d.conv_id IS NOT DISTINCT FROM fold.conv_id AND d.pos = fold.pos + 1))),
best AS (SELECT conv_id, list_min([e, a, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || nl(u.t) || 'assistant:'}, {'c': s.c + 10, 'a': s.a || 'II', 't': s.t || nl(s.t) || 'user:' || chr(10) || 'assistant:'}]) AS b
  FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (j IS NOT NULL AND (j || i) NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY 1)
SELECT o.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
  coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
# a line feed between lines, none before the first
for _state in ("e", "s", "u", "a"):
    ORACLE = ORACLE.replace(f"nl({_state}.t)", f"CASE {_state}.t WHEN '' THEN '' ELSE chr(10) END")
