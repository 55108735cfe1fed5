"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines carry quote levels (leading `>` marks). Runs of lines of one level are
passages. Quoted passages, their paragraphs and lines are normalised and hashed, and joined to
the messages of the same conversation whose own words hash alike. The longest piece found at
the outermost level names the message that is answered; following these links gives each
message its thread and depth. Content is the message without quotes.

Parsing stays inside the row and is done once: the parsed rows are written. Hashes of own
words are reduced to one row for each conversation and hash before the join, so a very common
line is no heavier than another; links are followed by pointer doubling, in as many rounds as the logarithm of the longest
chain. No conversation is collected: order by (conv_id, thread_root, turn) to read one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, written

#: Marks in front of a line, each with white space before it; then one blank.
MARKS = r"^(?:[ \t]*>)*"
#: A line that says who wrote what is quoted below it.
ATTRIBUTION = r"(?i)^.*\bwrote:[ \t]*$"
BLANKS = " \t\n\r\f\x0b"
GAPS = r"[ \t\n\r\f\x0B]+"


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(text, F.lit(BLANKS)), GAPS, " "))


def pieces(text: Column) -> Column:
    """A passage as hashed pieces: all of it, its paragraphs and its lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"))
    kept = F.array_distinct(F.filter(F.transform(parts, normalised), lambda p: p != ""))
    return F.transform(kept, lambda p: F.struct(F.md5(p.cast("binary")).alias("hash"), F.length(p).alias("size")))


def parsed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds content, own (hashed pieces of the content) and quoted (level, number, hashed pieces)."""
    lines = df.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\r\n|\r|\n"))
    levels = lines.withColumn(
        "__lines",
        F.transform(
            "__lines",
            # most lines have no mark; they only lose one blank in front
            lambda x: F.when(
                F.contains(x, F.lit(">")),
                F.struct(
                    F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
                    F.regexp_replace(x, MARKS + " ?", "").alias("body"),
                ),
            ).otherwise(F.struct(F.lit(0).alias("level"), F.when(F.startswith(x, F.lit(" ")), F.substring(x, 2, 2**31 - 1)).otherwise(x).alias("body"))),
        ),
    )
    level = lambda i: F.get("__lines", i)["level"]
    marked = levels.withColumn("__n", F.size("__lines")).withColumn(
        "__lines",
        F.transform(
            "__lines",
            lambda x, i: F.struct(
                F.when((x["level"] == 0) & (F.coalesce(level(i + 1), F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION), F.lit(-1))
                .otherwise(x["level"])
                .alias("level"),
                x["body"].alias("body"),
            ),
        ),
    )
    starts = marked.withColumn(
        "__starts",
        F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (level(i) > 0) & ((i == 0) | (level(i) != level(i - 1)))),
    ).withColumn(
        "__ends",
        F.filter(F.sequence(F.lit(1), F.col("__n")), lambda i: (level(i - 1) > 0) & ((i == F.col("__n")) | (F.coalesce(level(i), F.lit(-2)) != level(i - 1)))),
    )
    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return (
        starts.withColumn("content", F.regexp_replace(F.btrim(own, F.lit(BLANKS)), r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n"))
        .withColumn("own", pieces(F.col("content")))
        .withColumn(
            "quoted",
            F.transform(
                "__starts",
                lambda s, i: F.struct(
                    level(s).alias("level"),
                    i.alias("number"),
                    pieces(
                        F.array_join(F.transform(F.slice("__lines", s + 1, F.get("__ends", i) - s), lambda x: x["body"]), "\n")
                    ).alias("pieces"),
                ),
            ),
        )
        .drop("__lines", "__n", "__starts", "__ends")
    )


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, linked) of the messages that quote an earlier one. `messages`: parsed, as conv and turn."""
    known = messages.filter("conv IS NOT NULL AND turn IS NOT NULL")
    origins = (
        known.select("conv", "turn", F.explode("own").alias("p"))
        .groupBy("conv", F.col("p.hash").alias("hash"))
        .agg(F.min("turn").alias("origin"))
    )
    quotes = (
        known.filter(F.size("quoted") > 0)
        .select("conv", "turn", F.explode("quoted").alias("q"))
        .select("conv", "turn", "q.level", "q.number", F.explode("q.pieces").alias("p"))
        .select("conv", "turn", "level", "number", "p.hash", "p.size")
    )
    found = quotes.join(origins, ["conv", "hash"]).filter("origin < turn")
    return (
        found.groupBy("conv", "turn")
        .agg(
            F.max(F.struct((-F.col("level")).alias("level"), "size", "origin")).alias("best"),
            F.count_distinct("number").cast("bigint").alias("linked"),
        )
        .select("conv", "turn", F.col("best.origin").alias("parent"), "linked")
    )


def threads(links: DataFrame) -> DataFrame:
    """Adds root and depth to (conv, turn, parent): pointers double until each ends at a message without a parent."""
    at = written(links.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("bigint")), "chat-links")
    while True:
        up = at.select(F.col("conv"), F.col("turn").alias("root"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        if at.join(up.select("conv", "root"), ["conv", "root"], "left_semi").isEmpty():
            return at
        at = written(
            at.join(up, ["conv", "root"], "left").select(
                "conv",
                "turn",
                "parent",
                "linked",
                F.coalesce("__root", "root").alias("root"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            ),
            "chat-threads",
        )


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: conv, turn, role, content, n_quotes, n_linked, parent_turn, thread_root, depth, formatted.

    content: the text without quoted lines and the lines that introduce them. n_quotes: quoted
    passages; n_linked: those found in an earlier message of the conversation. parent_turn: the
    answered message's turn, null if none is found (depth 0, own thread). formatted: the message
    in chat markup. A piece that several earlier messages have belongs to the earliest. Null
    text counts as empty; rows with a null conversation or turn link to nothing. Messages that
    repeat a conversation and turn share what either links to. Columns of other names don't
    matter. An empty table gives an empty result.
    """
    require(df, conv_col, turn_col, role_col, text_col)
    messages = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = written(parsed(messages).drop("text"), "chat-parsed")
    linked = threads(reply_links(rows.select("conv", "turn", "own", "quoted")))
    return (
        rows.select("conv", "turn", "role", "content", F.size("quoted").cast("bigint").alias("n_quotes"))
        .join(linked, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias(conv_col),
            F.col("turn").alias(turn_col),
            F.col("role").alias(role_col),
            "content",
            "n_quotes",
            F.coalesce("linked", F.lit(0)).cast("bigint").alias("n_linked"),
            F.col("parent").alias("parent_turn"),
            F.coalesce("root", "turn").alias("thread_root"),
            F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n")).alias("formatted"),
        )
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS m, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM conversations
), x AS (
  SELECT m, conv_id, turn, i, regexp_replace(line, '^(?:[ \t]*>)* ?', '') AS body,
         length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)*', 0), '[^>]', '', 'g')) AS lv
  FROM (SELECT m, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l)
), y AS (
  SELECT *, CASE WHEN lv = 0 AND regexp_matches(body, '(?i)^.*\bwrote:[ \t]*$') AND coalesce(lead(lv) OVER (PARTITION BY m ORDER BY i), 0) > 0
                 THEN -1 ELSE lv END AS level FROM x
), z AS (
  SELECT *, sum(b) OVER (PARTITION BY m ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY i) THEN 1 ELSE 0 END AS b FROM y)
), c AS (
  SELECT m, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''),
           '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '\n[ \t]*(?:\n[ \t]*)+\n', chr(10) || chr(10), 'g') AS content FROM y GROUP BY m
), q AS (
  SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, level, run, string_agg(body, chr(10) ORDER BY i) AS body
  FROM z WHERE level > 0 GROUP BY m, level, run
), p AS (
  SELECT l.m, conv_id, turn, 0 AS level, 0 AS run, content AS body FROM c JOIN l USING (m) UNION ALL
  SELECT m, conv_id, turn, level, run, body FROM q
), h AS (
  SELECT DISTINCT m, conv_id, turn, level, run, lower(regexp_replace(regexp_replace(piece,
           '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS piece
  FROM (SELECT * EXCLUDE (body), unnest(list_concat([body], string_split_regex(body, '\n[ \t]*\n'), string_split(body, chr(10)))) AS piece FROM p)
), o AS (
  SELECT conv_id, piece, min(turn) AS origin FROM h WHERE level = 0 AND piece <> '' GROUP BY conv_id, piece
), f AS (
  SELECT h.conv_id, h.turn, arg_max(origin, (-level, length(h.piece), origin)) AS parent, count(DISTINCT run) AS linked
  FROM h JOIN o ON h.conv_id = o.conv_id AND h.piece = o.piece AND o.origin < h.turn WHERE level > 0 GROUP BY h.conv_id, h.turn
), t AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM f UNION ALL
  SELECT t.conv_id, t.turn, f.parent, t.depth + 1 FROM t JOIN f ON t.conv_id = f.conv_id AND t.root = f.turn
), r AS (
  SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM t GROUP BY conv_id, turn
)
SELECT l.conv_id, l.turn, l.role, content, (SELECT count(*) FROM q WHERE q.m = l.m) AS n_quotes, coalesce(linked, 0) AS n_linked,
       f.parent AS parent_turn, coalesce(r.root, l.turn) AS thread_root, coalesce(depth, 0)::BIGINT AS depth,
       '<|' || coalesce(l.role, 'unknown') || '|>' || chr(10) || content || chr(10) AS formatted
FROM l JOIN c USING (m) LEFT JOIN f ON f.conv_id = l.conv_id AND f.turn = l.turn LEFT JOIN r ON r.conv_id = l.conv_id AND r.turn = l.turn
"""
