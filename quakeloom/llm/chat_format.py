"""Quotation linking in conversations, in DataFrame operations only.

A line's quote level is the number of ">" before its words. Runs of lines of one level are passages; their words,
lower-cased and single-spaced, are hashed and looked up among the texts, paragraphs and lines that earlier messages of
the conversation wrote themselves. A passage that none of them wrote as such, as it takes only some paragraphs or lines of
a message, is looked up by its paragraphs, and failing these by its lines; it then comes from the turn that most of its
characters come from. A message replies to the latest message that its outermost linked quotation comes from, or else to
the turn before it. Replies to any other turn open a branch; a conversation ordered by branch and turn has every message
after the one that it replies to, and each branch unbroken. Quotes are left out of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

MARK = "^(?:> ?)+"
#: Turns that one window spans; longer conversations are split into such stretches.
STRETCH = 256


def _words(text: str) -> str:
    """SQL: the words of a text, lower-cased and single-spaced."""
    return f"trim(regexp_replace(lower({text}), '\\\\s+', ' '))"


def _norm(text: str) -> str:
    """SQL: hash of the words of a text, null where it has none."""
    return f"nullif(md5({_words(text)}), md5(''))"


def _runs(level: str) -> str:
    """SQL: (from, to) places of the maximal runs of lines that satisfy `level` and are equal in it, for arrays lvl and body."""
    starts = f"filter(places, i -> {level.format('lvl[i]')} AND (i = 0 OR lvl[greatest(i - 1, 0)] <> lvl[i]))"
    ends = f"filter(places, i -> {level.format('lvl[i]')} AND (i = size(lvl) - 1 OR lvl[least(i + 1, size(lvl) - 1)] <> lvl[i]))"
    return f"arrays_zip({starts} AS s, {ends} AS e)"


def parse(messages: DataFrame) -> DataFrame:
    """messages with lines taken apart: lvl (quote level), body (the line without its marks) and places (0 .. lines - 1)."""
    out = messages.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    out = out.withColumn("lvl", F.expr(f"transform(lines, x -> length(translate(regexp_extract(x, '{MARK}', 0), ' ', '')))"))
    return out.withColumn("body", F.expr(f"transform(lines, x -> regexp_replace(x, '{MARK}', ''))")).withColumn("places", F.expr("sequence(0, size(lines) - 1)")).drop("lines")


def quotations(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, no, level, run, rank, hash, size): the parts of each quoted passage of the messages.

    no: the passage's first line in its message; run: the hash of the whole passage; rank: 0 for the whole, 1 for its
    paragraphs, 2 for its lines; size: the characters of the part's words.
    """
    runs = parsed.filter("exists(lvl, x -> x > 0)").withColumn("runs", F.expr(_runs("{} > 0").replace(" AS s", "").replace(" AS e", "")))
    one = runs.select("conv_id", "turn", "lvl", "body", F.explode("runs").alias("r")).select("conv_id", "turn", F.expr("r['0']").alias("no"), F.expr("lvl[r['0']]").alias("level"), F.expr("array_join(slice(body, r['0'] + 1, r['1'] - r['0'] + 1), '\n')").alias("passage"))
    one = one.withColumn("run", F.expr(_norm("passage"))).filter("run IS NOT NULL")
    parts = "concat(array(struct(0 AS rank, passage AS part)), transform(split(passage, '\\n\\\\s*\\n'), x -> struct(1 AS rank, x AS part)), transform(split(passage, '\\n'), x -> struct(2 AS rank, x AS part)))"
    each = one.select("conv_id", "turn", "no", "level", "run", F.explode(F.expr(parts)).alias("p")).select("*", "p.rank", F.expr(_norm("p.part")).alias("hash"), F.expr(f"length({_words('p.part')})").alias("size"))
    return each.drop("p").filter("hash IS NOT NULL")


def own_units(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): what each message wrote itself, as a whole, by paragraph and by line."""
    own = parsed.select("conv_id", "turn", F.expr("array_join(transform(filter(places, i -> lvl[i] = 0), i -> body[i]), '\n')").alias("own"))
    unit = own.select("conv_id", "turn", F.explode(F.expr("array_distinct(concat(array(own), split(own, '\\n\\\\s*\\n'), split(own, '\\n')))")).alias("unit"))
    return unit.select("conv_id", "turn", F.expr(_norm("unit")).alias("hash")).filter("hash IS NOT NULL").distinct()


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, no, level, run, original): the passages of quotations(parsed) that an earlier turn of the conversation wrote.

    Parts are looked up by a running maximum over the turns of each (conversation, hash), so equal ones are never paired;
    the latest turn that wrote a part counts. original: of the turns that the passage's best rank of parts comes from, the
    one with most characters, the latest of equals.
    """
    quotes = quotations(parsed)
    units = own_units(parsed.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi"))
    both = quotes.withColumn("wrote", F.lit(None).cast("long")).unionByName(units.withColumn("wrote", F.col("turn").cast("long")), allowMissingColumns=True)
    found = _running(both, ["conv_id", "hash"], "wrote", "original", own=False).filter("level IS NOT NULL AND original IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "no", "level", "run", "rank", "original").agg(F.sum("size").alias("size"))
    return votes.groupBy("conv_id", "turn", "no", "level", "run").agg(F.max_by("original", F.struct(-F.col("rank"), F.col("size"), F.col("original"))).alias("original"))


def _running(rows: DataFrame, keys: list[str], value: str, name: str, own: bool) -> DataFrame:
    """rows with the largest `value` among their key's turns up to this one (own) or before it, by stretches of turns: one
    pass within a stretch, and one over the stretches' maxima. So no key, however frequent, is one task's work."""
    t = rows.withColumn("part", F.floor(F.col("turn") / F.lit(STRETCH)))
    ends = t.groupBy(*keys, "part").agg(F.max(value).alias("top"))
    over = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "part", F.max("top").over(over).alias("carried"))
    inside = Window.partitionBy(*keys, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0 if own else -1)
    return t.withColumn("within", F.max(value).over(inside)).join(ends, [*keys, "part"]).withColumn(name, F.coalesce("within", "carried")).drop("part", "within", "carried")


def own_text() -> Column:
    own = F.expr("array_join(transform(filter(places, i -> lvl[i] = 0), i -> body[i]), '\n')")
    return F.when(F.expr("exists(lvl, x -> x > 0)"), F.btrim(own, F.lit("\n"))).otherwise(own)


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to (turn), branch (turn that opened it), n_quotes, n_linked, text.

    Order by conv_id, branch, turn for reading. Null texts count as empty. Messages with equal conversation and turn
    (repeats too) share their links. A null conv_id or turn leaves reply_to and branch null. An empty table gives an
    empty result.
    """
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    turns = _running(parsed.select("conv_id", "turn").filter("conv_id IS NOT NULL AND turn IS NOT NULL").distinct(), ["conv_id"], "turn", "previous", own=False)
    linked = link(parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")).groupBy("conv_id", "turn").agg(
        F.countDistinct("no", "run").alias("n_linked"),
        F.max_by("original", F.struct(-F.col("level"), F.col("original"))).alias("quoted"),
    )
    turns = turns.join(linked, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("quoted", "previous"))
    opens = F.when(F.col("previous").isNull() | (F.col("reply_to") != F.col("previous")), F.col("turn"))
    turns = _running(turns.withColumn("opens", opens), ["conv_id"], "opens", "branch", own=True)
    quoted = F.expr(f"size({_runs('{} > 0')})".replace(" AS s", "").replace(" AS e", ""))
    rows = parsed.select("conv_id", "turn", "role", quoted.cast("long").alias("n_quotes"), own_text().alias("text"))
    full = rows.join(turns.select("conv_id", "turn", "reply_to", "branch", "n_linked"), ["conv_id", "turn"], "left")
    return full.select("conv_id", "turn", "role", "reply_to", "branch", "n_quotes", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "text")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    def w(x: str) -> str:
        return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"

    def h(x: str) -> str:
        return f"nullif(md5({w(x)}), md5(''))"

    return f"""WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
    l AS (SELECT rid, conv_id, turn, role, i, lines[i] AS line, length(replace(regexp_extract(lines[i], '{MARK}'), ' ', '')) AS lvl, regexp_replace(lines[i], '{MARK}', '') AS body
        FROM m, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
    g AS (SELECT *, sum(step) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, CASE WHEN lvl IS DISTINCT FROM lag(lvl) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS step FROM l)),
    runs AS (SELECT rid, conv_id, turn, min(i) AS no, lvl, string_agg(body, chr(10) ORDER BY i) AS passage FROM g WHERE lvl > 0 GROUP BY rid, conv_id, turn, run, lvl),
    whole AS (SELECT *, {h('passage')} AS run FROM runs WHERE {h('passage')} IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
    parts AS (SELECT *, 0 AS rank, passage AS part FROM whole UNION ALL SELECT *, 1, unnest(regexp_split_to_array(passage, '\\n\\s*\\n')) FROM whole UNION ALL SELECT *, 2, unnest(string_split(passage, chr(10))) FROM whole),
    quotes AS (SELECT conv_id, turn, no, lvl, run, rank, {h('part')} AS hash, length({w('part')}) AS size FROM parts WHERE {h('part')} IS NOT NULL),
    own AS (SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (lvl = 0), '') AS own, max(lvl) AS deep FROM l GROUP BY rid),
    units AS (SELECT DISTINCT conv_id, turn, {h('u')} AS hash FROM (SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\\n\\s*\\n'), string_split(own, chr(10)))) AS u FROM own)),
    votes AS (SELECT conv_id, turn, no, lvl, run, rank, original, sum(size) AS size FROM (SELECT q.*, (SELECT max(u.turn) FROM units u WHERE u.conv_id = q.conv_id AND u.hash = q.hash AND u.turn < q.turn) AS original FROM quotes q) WHERE original IS NOT NULL GROUP BY ALL),
    passages AS (SELECT conv_id, turn, no, lvl, run, arg_max(original, (-rank, size, original)) AS original FROM votes GROUP BY conv_id, turn, no, lvl, run),
    linked AS (SELECT conv_id, turn, count(DISTINCT (no, run)) AS n_linked, arg_max(original, (-lvl, original)) AS quoted FROM passages GROUP BY conv_id, turn),
    t0 AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
    t1 AS (SELECT t0.*, n_linked, coalesce(quoted, previous) AS reply_to FROM t0 LEFT JOIN linked USING (conv_id, turn)),
    t2 AS (SELECT *, max(CASE WHEN previous IS NULL OR reply_to <> previous THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch FROM t1)
    SELECT own.conv_id, own.turn, role, reply_to, branch, (SELECT count(*) FROM runs WHERE runs.rid = own.rid) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
        CASE WHEN deep > 0 THEN trim(own, chr(10)) ELSE own END AS text FROM own LEFT JOIN t2 ON t2.conv_id = own.conv_id AND t2.turn = own.turn"""


QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLE_SQL = {"op8_chat_formatting": _sql()}
