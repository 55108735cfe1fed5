"""Queries on names and validation, libraries, jobs and their events, and plain relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators import libraries as L
from chronoloom.operators import sessions as S
from chronoloom.operators import validate as VA
from chronoloom.plans.speech import PHRASES
from chronoloom.sources import views as V
from chronoloom.sources.views import EVENTS_SQL, WORDS_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"""WITH {WORDS_SQL}, n AS (
  SELECT regexp_replace(word, '[^\pL\pN_]', '', 'g') AS name, i - min(i) OVER (PARTITION BY media_id, segment_id) AS pos FROM words
)
SELECT name, count(*) AS times FROM n WHERE regexp_matches(name, '^\p{{Lu}}') AND length(name) > 1 AND name <> upper(name) GROUP BY name HAVING count(*) >= 2 AND max(pos) > 0""")
def proper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = V.words_once(spark, sf_dir)
    first = words.groupBy("media_id", "segment_id").agg(F.min("i").alias("first"))
    return VA.candidate_names(words.join(first, ["media_id", "segment_id"]).withColumn("pos", F.col("i") - F.col("first")))


#: What is added to a segment's text, and to its translation back, by the segment's number.
SAID = ["", " e não vai", " FALTOU fazer", " vai nadar, nemesis", " sem ela", " Ninguém sabe", " senão", " nenhuma"]


@query(f"""WITH {WORDS_SQL}, t AS (
  SELECT media_id, segment_id, text || ({SAID})[segment_id % 8 + 1] AS a, text || ({SAID})[segment_id // 3 % 8 + 1] AS b FROM segs
), n AS (
  SELECT *, ['não', 'nao', 'nunca', 'nem', 'nenhum', 'nenhuma', 'ninguém', 'ninguem', 'nada', 'jamais', 'sem', 'faltou', 'falta', 'faltava', 'faltar', 'faltaram'] AS no FROM t
), f AS (
  SELECT media_id, segment_id, list_filter(regexp_extract_all(lower(a), '[\\pL\\pN_]+'), lambda w: list_contains(no, w))[1] AS a, list_filter(regexp_extract_all(lower(b), '[\\pL\\pN_]+'), lambda w: list_contains(no, w))[1] AS b FROM n
)
SELECT media_id, segment_id, CASE WHEN a IS NOT NULL AND b IS NULL THEN 'source: ' || a WHEN a IS NULL AND b IS NOT NULL THEN 'target: ' || b END AS mismatch FROM f""")
def negation_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, said = F.col("segment_id"), F.array(*[F.lit(x) for x in SAID])
    source, back = (F.concat("text", F.get(said, k.cast("int"))) for k in (n % 8, F.floor(n / 3) % 8))
    return V.segments(V.words(spark, sf_dir)).select("media_id", "segment_id", VA.negation_mismatch(source, back).alias("mismatch"))


#: Lines of groups by number.
LINES = ["好", "OK吧", "长" * 21, "你好,世界", "Ünï", "什么？！", "他说:“好”"]


@query(f"""WITH {WORDS_SQL}, {PHRASES}, c AS (
  SELECT media_id, phrase AS card FROM phrases
), g AS (
  SELECT media_id, (phrase // 3)::BIGINT AS grp, list(phrase ORDER BY CASE WHEN phrase // 3 % 7 = 3 AND media_id % 3 = 1 THEN -phrase ELSE phrase END) AS cards, min(start_ms) AS start_ms, max(end_ms) AS end_ms
  FROM phrases WHERE media_id % 3 > 0 OR phrase % 10 <> 9 GROUP BY media_id, phrase // 3
), g2 AS (
  SELECT media_id, grp, CASE WHEN grp % 11 = 4 AND media_id % 3 = 0 THEN list_concat(cards, [cards[1], 100000]) ELSE cards END AS cards, start_ms, end_ms,
         ({LINES})[grp % 7 + 1] AS line, CASE WHEN grp % 6 = 5 THEN 'look' ELSE '' END AS flag FROM g
), u AS (
  SELECT media_id, grp, unnest(range(len(cards))) AS pos, unnest(cards) AS card FROM g2
), cov AS (
  SELECT media_id, 'missing' AS rule, card::BIGINT::VARCHAR AS detail FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.media_id = c.media_id AND u.card = c.card)
  UNION ALL SELECT DISTINCT media_id, 'unknown', card::BIGINT::VARCHAR FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE u.media_id = c.media_id AND u.card = c.card)
  UNION ALL SELECT media_id, 'repeated', card::BIGINT::VARCHAR FROM u JOIN c USING (media_id, card) GROUP BY media_id, card HAVING count(*) > 1
), seqs AS (
  SELECT media_id, list(card ORDER BY grp, pos) AS cards, list(grp ORDER BY grp, pos) AS grps FROM u WHERE media_id NOT IN (SELECT media_id FROM cov) GROUP BY media_id
)
FROM cov
UNION ALL SELECT media_id, 'order', grps[list_filter(range(2, len(cards) + 1), lambda k: cards[k] < cards[k - 1])[1]]::BIGINT::VARCHAR FROM seqs WHERE cards <> list_sort(cards)
UNION ALL SELECT media_id, 'short', grp::BIGINT::VARCHAR FROM g2 WHERE end_ms - start_ms < 1200
UNION ALL SELECT media_id, 'flag', grp::BIGINT::VARCHAR || ': look' FROM g2 WHERE flag <> ''
UNION ALL SELECT media_id, 'script', grp::BIGINT::VARCHAR FROM g2 WHERE regexp_matches(line, '[A-Za-z]')
UNION ALL SELECT media_id, 'marks', grp::BIGINT::VARCHAR FROM g2 WHERE translate(line, ',.;:!?"''()', '') <> line
UNION ALL SELECT media_id, 'long', grp::BIGINT::VARCHAR FROM g2 WHERE length(line) > 20""")
def group_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = S.phrases(V.words_once(spark, sf_dir))
    m, k = F.col("media_id") % 3, F.col("group")
    numbered = phrases.filter((m > 0) | (F.col("phrase") % 10 != 9)).withColumn("group", F.expr("phrase DIV 3"))
    groups = numbered.groupBy("media_id", "group").agg(F.array_sort(F.collect_list("phrase")).alias("cards"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    turned = F.when((k % 7 == 3) & (m == 1), F.reverse("cards")).when((k % 11 == 4) & (m == 0), F.concat("cards", F.array(F.get("cards", 0), F.lit(100000)))).otherwise(F.col("cards"))
    line, flag = F.get(F.array(*[F.lit(x) for x in LINES]), (k % 7).cast("int")), F.when(k % 6 == 5, "look").otherwise("")
    groups = groups.withColumn("cards", turned).withColumn("line", line).withColumn("flag", flag)
    return VA.group_violations(groups, phrases.select("media_id", F.col("phrase").alias("card"), "text"))


@query("""WITH s AS (SELECT n_name AS source, 'kept ' || n_nationkey AS rendering FROM nation WHERE n_nationkey % 2 = 0),
n AS (SELECT n_name AS source, CASE WHEN n_nationkey % 5 = 1 THEN ' ' ELSE 'new ' || n_nationkey END AS rendering FROM nation)
SELECT * FROM s UNION ALL SELECT * FROM n WHERE trim(rendering) <> '' AND source NOT IN (SELECT source FROM s)""")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, k = V.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    stored = nation.filter(k % 2 == 0).select(F.col("n_name").alias("source"), F.concat(F.lit("kept "), k).alias("rendering"))
    new = nation.select(F.col("n_name").alias("source"), F.when(k % 5 == 1, " ").otherwise(F.concat(F.lit("new "), k)).alias("rendering"))
    return L.insert_only(stored, new, ["source"], "rendering")


@query("""WITH i AS (SELECT p_partkey AS id, substr(sha1(p_name || '|' || p_brand), 1, 12) AS hash FROM part),
k AS (SELECT p_partkey AS id, substr(sha1(p_name || '|' || CASE WHEN p_partkey % 4 = 0 THEN 'old' ELSE p_brand END), 1, 12) AS hash FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT p_partkey AS id FROM part WHERE p_size > 10)
SELECT i.id, CASE WHEN k.hash = i.hash THEN 'taught' WHEN f.id IS NULL THEN 'missing' ELSE 'pending' END AS status FROM i LEFT JOIN k USING (id) LEFT JOIN f USING (id)""")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_parts(spark, sf_dir)


def pending_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.functions.text import short_hash

    part, key = V.table(spark, sf_dir, "part"), F.col("p_partkey").alias("id")
    items = part.select(key, short_hash(F.col("p_name"), F.col("p_brand")).alias("hash"))
    brand = F.when(F.col("p_partkey") % 4 == 0, "old").otherwise(F.col("p_brand"))
    known = part.filter("p_partkey % 2 = 0").select(key, short_hash(F.col("p_name"), brand).alias("hash"))
    return L.pending(items, known, part.filter("p_size > 10").select(key), "id")


@query("""WITH i AS (SELECT p_partkey AS id, p_brand FROM part)
SELECT status, count(*) AS items, row_number() OVER (ORDER BY count(*) DESC, status) AS place FROM (
  SELECT CASE WHEN p_partkey % 4 = 2 THEN 'taught' WHEN p_size <= 10 THEN 'missing' ELSE 'pending' END AS status FROM part) GROUP BY status""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    counts = pending_parts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("items"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("items"), "status")).cast("bigint"))


@query("""WITH e AS (
  SELECT o_orderkey AS export_id, 'clip' || (o_custkey % 300) AS name, (o_totalprice * 10)::BIGINT AS range_ms, (o_totalprice * 11)::BIGINT AS whole_ms, o_orderdate AS modified FROM orders
), u AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY name, range_ms // 100000 ORDER BY modified, export_id) = 1
), f AS (
  SELECT c_custkey AS file_id, 'clip' || (c_custkey % 350) AS name, (abs(c_acctbal) * 200)::BIGINT AS file_ms FROM customer
), n AS (
  SELECT *, CASE WHEN abs(range_ms - file_ms) <= 5000 THEN 0 WHEN abs(whole_ms - file_ms) <= 5000 THEN 1 END AS rank FROM u JOIN f USING (name)
), b AS (
  SELECT export_id, arg_min(file_id, (rank, CASE WHEN rank = 0 THEN abs(range_ms - file_ms) ELSE abs(whole_ms - file_ms) END, file_id)) AS file_id FROM n WHERE rank IS NOT NULL GROUP BY export_id
), c AS (
  SELECT file_id, count(*) AS claims FROM b GROUP BY file_id
)
SELECT u.export_id, u.name, CASE WHEN claims = 1 THEN b.file_id END AS file_id,
       CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.name = u.name) THEN 'no file of this name' WHEN b.file_id IS NULL THEN 'no file of this length' WHEN claims > 1 THEN 'claimed more than once' END AS reason
FROM u LEFT JOIN b USING (export_id) LEFT JOIN c ON c.file_id = b.file_id""")
def export_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit("clip"), F.col(c) % n).alias("name")
    ms = lambda c, n: F.rint(c * n).cast("bigint")  # noqa: E731  halves to even
    exports = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("export_id"), name("o_custkey", 300), ms(F.col("o_totalprice"), 10).alias("range_ms"), ms(F.col("o_totalprice"), 11).alias("whole_ms"), F.col("o_orderdate").alias("modified")
    )
    unique = L.unique_exports(exports.withColumn("about", F.expr("range_ms DIV 100000")), ["name", "about"], "modified", "export_id")
    files = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), name("c_custkey", 350), ms(F.abs("c_acctbal"), 200).alias("file_ms"))
    return L.pair_exports(unique, files, 5000)


@query("""SELECT p_type AS kind, count(*) FILTER (p_size % 2 = 0) AS long_form, count(*) FILTER (p_size % 2 = 1) AS short_form, count(*) AS total, greatest(0, 300 - count(*)) AS remaining FROM part GROUP BY p_type""")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("p_size") % 2 == 1
    return V.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count_if(~odd).alias("long_form"), F.count_if(odd).alias("short_form"), F.count("*").alias("total"), F.greatest(F.lit(0).cast("bigint"), 300 - F.count("*")).alias("remaining")
    )


@query(f"""WITH {EVENTS_SQL}
SELECT media_id, count_if(kind = 'view') AS running, count_if(kind IN ('click', 'signup')) AS queued, count_if(kind = 'error') AS failed, count_if(kind = 'purchase') AS done,
       arg_min(event_id, (t_ms, event_id)) FILTER (kind = 'view') AS current FROM points GROUP BY media_id""")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    first = F.min_by("event_id", F.when(kind == "view", F.struct("t_ms", "event_id")))
    return V.event_points(spark, sf_dir).groupBy("media_id").agg(
        F.count_if(kind == "view").alias("running"), F.count_if(kind.isin("click", "signup")).alias("queued"), F.count_if(kind == "error").alias("failed"),
        F.count_if(kind == "purchase").alias("done"), first.alias("current"),
    )


def task_events(events: DataFrame) -> DataFrame:
    """Events as those of jobs: the user is the task, the type its status, the value of views its percentage."""
    percent = F.when(F.col("event_type") == "view", F.least(F.floor("value"), F.lit(100)).cast("bigint"))
    return events.select(F.col("user_id").alias("task"), "event_id", F.col("event_type").alias("status"), percent.alias("percent"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""WITH e AS (
  SELECT user_id AS task, event_id, event_type AS status, CASE WHEN event_type = 'view' THEN least(floor(value), 100)::BIGINT END AS percent, (props->>'k')::BIGINT AS k FROM events
)
SELECT task, arg_max(status, event_id) AS status, max(event_id) AS event_id, arg_max(percent, event_id) FILTER (percent IS NOT NULL) AS percent, arg_max(k, event_id) FILTER (k IS NOT NULL) AS k, count(*) AS events
FROM e GROUP BY task""")
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_state(task_events(V.table(spark, sf_dir, "events")), "task", ["event_id"], ["status", "event_id"], ["percent", "k"])


def runner_events(events: DataFrame) -> DataFrame:
    """Events as what the runner of a user's job says; the last one is its exit."""
    n, last = F.col("event_id"), F.col("event_id") == F.max("event_id").over(W.partitionBy("user_id"))
    kinds = F.array(*[F.lit(x) for x in ("status", "status", "status", "translation-done", "translation-error", "log", "done", "error", "log", "cancel")])
    kind = F.when(last, "exit").when((n % 10 == 9) & (n % 90 != 9), "log").otherwise(F.get(kinds, (n % 10).cast("int")))
    text = lambda name, when: F.when(when, F.concat(F.lit(name), n))
    return events.select(
        F.col("user_id").alias("task"), n, kind.alias("event"), F.col("event_type").alias("status"), text("stage ", n % 2 == 0).alias("stage"), text("said ", (n % 3 > 0) & ~last).alias("message"),
        F.when(n % 4 > 0, F.least(F.floor("value"), F.lit(100)).cast("double")).alias("progress"), text("/out/", n % 5 < 4).alias("output_path"), F.when(n % 7 == 0, "pt").alias("language"),
        F.when(n % 3 == 1, n % 50).alias("processed"), F.when(n % 11 == 1, 50).cast("bigint").alias("total"), F.get(F.array(F.lit("zh"), F.lit("en"), F.lit("es")), (n % 3).cast("int")).alias("lang"),
        text("wrong ", n % 4 == 1).alias("error"), F.when(last, F.col("user_id") % 3).alias("code"),
    )


@query("""WITH e AS (
  SELECT user_id AS task, event_id AS n, event_id = max(event_id) OVER (PARTITION BY user_id) AS last, event_type, value FROM events
), k AS (
  SELECT *, CASE WHEN last THEN 'exit' WHEN n % 10 < 3 THEN 'status' WHEN n % 10 = 3 THEN 'translation-done' WHEN n % 10 = 4 THEN 'translation-error' WHEN n % 10 = 6 THEN 'done' WHEN n % 10 = 7 THEN 'error' WHEN n % 90 = 9 THEN 'cancel' ELSE 'log' END AS kind,
         CASE WHEN n % 2 = 0 THEN 'stage ' || n END AS stage, CASE WHEN n % 3 > 0 AND NOT last THEN 'said ' || n END AS message, CASE WHEN n % 4 > 0 THEN least(floor(value), 100) END AS progress,
         CASE WHEN n % 5 < 4 THEN '/out/' || n END AS output, CASE WHEN n % 3 = 1 THEN n % 50 END AS processed, ['zh', 'en', 'es'][n % 3 + 1] AS lang, CASE WHEN n % 4 = 1 THEN 'wrong ' || n END AS error FROM e
), t AS (
  SELECT task, kind, string_agg(lang || '=' || v, ';' ORDER BY lang) AS v FROM (
    SELECT task, kind, lang, arg_max(CASE WHEN kind = 'translation-done' THEN coalesce(output, '') ELSE coalesce(error, message, '-') END, n) AS v FROM k WHERE kind LIKE 'translation%' GROUP BY task, kind, lang) GROUP BY task, kind
), s AS (
  SELECT task, count(*) AS events, max(n) AS last_event, arg_max(message, n) AS message, arg_max(stage, n) FILTER (kind = 'status' OR (kind LIKE 'translation%' AND stage IS NOT NULL)) AS last_stage,
         max(n) FILTER (kind = 'status') AS last_status, max(n) FILTER (kind LIKE 'translation%' AND stage IS NOT NULL) AS last_translation, arg_max(progress, n) FILTER (kind = 'status') AS progress,
         arg_max(output, n) FILTER (kind NOT LIKE 'translation%') AS output_path, arg_max(processed, n) FILTER (kind NOT LIKE 'translation%') AS processed,
         max(struct_pack(n := n, kind := kind, error := coalesce(error, message))) FILTER (kind IN ('done', 'error')) AS ending, coalesce(bool_or(kind = 'cancel'), false) AS cancelled FROM k GROUP BY task
), f AS (
  SELECT s.*, k.stage AS status_stage, s.task % 3 AS code, CASE WHEN last_translation > last_status OR last_status IS NULL THEN last_translation END AS tr FROM s LEFT JOIN k ON k.task = s.task AND k.n = s.last_status
)
SELECT f.task, events, last_event, CASE WHEN cancelled THEN 'cancelled' WHEN ending.kind = 'done' OR (ending IS NULL AND code = 0) THEN 'completed' ELSE 'error' END AS status,
       CASE WHEN tr IS NOT NULL THEN 'stage ' || tr ELSE status_stage END AS stage,
       CASE WHEN cancelled THEN 'Processo cancelado pelo usuario.' WHEN ending.kind = 'done' OR (ending IS NULL AND code = 0) THEN coalesce(message, 'Transcricao concluida.') ELSE message END AS message, progress, output_path, processed,
       coalesce(d.v, '') AS translated, coalesce(x.v, '') AS failed, ending.kind AS ended,
       CASE WHEN ending.kind = 'error' THEN ending.error WHEN NOT cancelled AND ending IS NULL AND code > 0 THEN 'exit code ' || code END AS error, cancelled
FROM f LEFT JOIN t d ON d.task = f.task AND d.kind = 'translation-done' LEFT JOIN t x ON x.task = f.task AND x.kind = 'translation-error'""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runners say as a stream that ends, folded in keyed state to a written table."""
    import uuid

    from chronoloom.streaming.tasks import fold_to_table, latest_states, pairs

    base = f"{V.shared_folder(spark)}/tasks_{uuid.uuid4().hex}"
    said = runner_events(V.table(spark, sf_dir, "events"))
    said.write.parquet(f"{base}/events")
    fold_to_table(spark.readStream.schema(said.schema).parquet(f"{base}/events"), f"{base}/states", f"{base}/checkpoint")
    states = latest_states(spark, f"{base}/states")
    return states.select(
        "task", "events", "last_event", "status", "stage", "message", "progress", "output_path", "processed", pairs(F.col("translated")).alias("translated"),
        pairs(F.transform_values("failed", lambda _, v: F.coalesce(v, F.lit("-")))).alias("failed"), "ended", "error", "cancelled",
    )


@query("""WITH o AS (
  SELECT user_id, epoch_us(ts) // 1000 AS t, value FROM events
), b AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 7200000 THEN 0 ELSE 1 END AS b FROM o
)
SELECT user_id, min(t) AS first_ms, max(t) AS last_ms, count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b) GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at most 2 h apart."""
    t = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    events = V.table(spark, sf_dir, "events").withColumn("t", t).withColumn("at", F.timestamp_millis("t"))
    grouped = events.groupBy("user_id", F.session_window("at", "7200.000001 seconds"))
    return grouped.agg(F.min("t").alias("first_ms"), F.max("t").alias("last_ms"), F.count("*").alias("events")).drop("session_window")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, sum((l_extendedprice * 100)::BIGINT)::BIGINT AS sum_cents, count(*) AS rows
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem").filter("l_shipdate <= DATE '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("sum_cents"), F.count("*").alias("rows")
    )


@query("""SELECT c_custkey, c_name, n_name, sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)::BIGINT)::BIGINT AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY ALL ORDER BY cents DESC, c_custkey LIMIT 20""")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: V.table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.sum(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("bigint")).alias("cents")
    return joined.groupBy("c_custkey", "c_name", "n_name").agg(cents).orderBy(F.desc("cents"), "c_custkey").limit(20)
