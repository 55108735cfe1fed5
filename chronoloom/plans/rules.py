"""Queries on translated lines by a glossary, on scores, job decisions and a user's timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import glossary_rules as G
from chronoloom.operators import jobs_rules as J
from chronoloom.operators import lines as X
from chronoloom.operators import sessions as S
from chronoloom.plans.speech import PHRASES
from chronoloom.sources import views as V
from chronoloom.sources.views import WORDS_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: One sign a nation, for its rendering.
SIGNS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人"


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the characters of their region's recording."""
    key = F.col("n_nationkey")
    return V.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("media_id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("variants"),
        F.concat(F.lit("卡"), F.substring(F.lit(SIGNS), key + 1, F.lit(1)), F.lit("多")).alias("rendering"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").otherwise("other").alias("gender"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source text and a translated line per customer, about its nation and the region's first, with the glossary."""
    cast = characters(spark, sf_dir)
    first = cast.groupBy("media_id").agg(F.min(F.struct("name", "rendering")).alias("o"))
    who = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")).join(cast.select("media_id", "name", "rendering"), "name").join(first, "media_id")
    a, b, ra, rb, k = F.col("name"), F.col("o.name"), F.col("rendering"), F.col("o.rendering"), F.col("c_custkey")
    source = F.when(k % 4 == 0, F.concat(a, F.lit(" casou com a "), b)).when(k % 4 == 1, F.concat(F.lit("ela viu "), a)).when(k % 4 == 2, F.concat(F.lit("o amigo do "), a)).otherwise(F.concat(a, F.lit(" saiu")))
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("她嫁给了"), ra)).when(k % 5 == 1, F.concat(ra, F.lit("想娶"), rb, F.lit("尔"))).when(k % 5 == 2, F.lit("他走了"))
        .when(k % 5 == 3, F.concat(rb, F.lit("嫁给"), ra)).otherwise(F.concat(F.lit("她和"), F.substring(rb, F.lit(1), F.lit(2)), F.lit("德结婚")))
    )
    said = V.table(spark, sf_dir, "customer").join(who, "c_nationkey").select("c_custkey", "media_id", source.alias("source"), line.alias("line"))
    return G.with_glossary(said, cast)


LINES = f"""
ch AS (
  SELECT n_nationkey, n_regionkey AS media_id, n_name AS name, '卡' || substr('{SIGNS}', n_nationkey + 1, 1) || '多' AS rendering,
         CASE n_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS gender FROM nation
), fst AS (
  SELECT media_id, min(name) AS b, arg_min(rendering, name) AS rb FROM ch GROUP BY media_id
), ln AS (
  SELECT c_custkey, media_id, CASE c_custkey % 4 WHEN 0 THEN name || ' casou com a ' || b WHEN 1 THEN 'ela viu ' || name WHEN 2 THEN 'o amigo do ' || name ELSE name || ' saiu' END AS source,
         CASE c_custkey % 5 WHEN 0 THEN '她嫁给了' || rendering WHEN 1 THEN rendering || '想娶' || rb || '尔' WHEN 2 THEN '他走了' WHEN 3 THEN rb || '嫁给' || rendering ELSE '她和' || substr(rb, 1, 2) || '德结婚' END AS line
  FROM customer JOIN ch ON n_nationkey = c_nationkey JOIN fst USING (media_id)
), pat AS (
  SELECT media_id, coalesce(string_agg(rendering, '|') FILTER (gender = 'male'), 'ZZ') AS men, coalesce(string_agg(rendering, '|') FILTER (gender = 'female'), 'ZZ') AS women FROM ch GROUP BY media_id
)"""


@query(rf"""WITH {LINES}, s AS (
  SELECT c_custkey, string_agg(name, ', ' ORDER BY name) FILTER (gender = 'male') AS males, string_agg(name, ', ' ORDER BY name) FILTER (gender = 'female') AS females
  FROM ln JOIN ch USING (media_id) WHERE len(regexp_extract_all(source, '(?i)\b' || name || '\b')) > len(regexp_extract_all(source, '(?i)\b(?:com|de|do|da)\s+(?:[oa]s?\s+)?' || name || '\b')) GROUP BY c_custkey
)
SELECT c_custkey, CASE WHEN line LIKE '%她%' AND males IS NOT NULL AND females IS NULL AND NOT regexp_matches(source, '\bela\b') THEN males
                       WHEN line LIKE '%他%' AND females IS NOT NULL AND males IS NULL THEN females END AS wrong FROM ln LEFT JOIN s USING (c_custkey)""")
def gender_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("c_custkey", G.gender_errors(F.col("source"), F.col("line"), F.col("glossary")).alias("wrong"))


@query(rf"""WITH {LINES}
SELECT c_custkey, CASE WHEN regexp_matches(line, '(他|' || men || '){G.LINKS}嫁给') THEN '嫁给' WHEN regexp_matches(line, '(她|' || women || '){G.LINKS}娶') THEN '娶' END AS subject_error,
       CASE WHEN regexp_matches(line, '嫁给?{G.PARTICLES}(' || women || ')') THEN '嫁给' WHEN regexp_matches(line, '娶{G.PARTICLES}(' || men || ')') THEN '娶' END AS object_error
FROM ln JOIN pat USING (media_id)""")
def marriage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, glossary = F.col("line"), F.col("glossary")
    return lines(spark, sf_dir).select("c_custkey", G.marriage_subject_error(line, glossary).alias("subject_error"), G.marriage_object_error(line, glossary).alias("object_error"))


@query(rf"""WITH {LINES}, m AS (
  SELECT c_custkey, string_agg(name, '|' ORDER BY name) FILTER (regexp_matches(source, '(?i)\b' || name || '\b') AND NOT contains(line, rendering)) AS missing,
         string_agg(rendering, '|' ORDER BY name) FILTER (NOT regexp_matches(source, '(?i)\b' || name || '\b') AND contains(line, rendering)) AS intruders
  FROM ln JOIN ch USING (media_id) GROUP BY c_custkey
)
SELECT c_custkey, missing, intruders FROM m WHERE missing IS NOT NULL AND intruders IS NOT NULL""")
def swapped_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("c_custkey", G.swapped_characters(F.col("source"), F.col("line"), F.col("glossary")).alias("s")).filter("s IS NOT NULL")
    return found.select("c_custkey", F.array_join("s.missing", "|").alias("missing"), F.array_join("s.intruders", "|").alias("intruders"))


@query(rf"""WITH {LINES}, v AS (
  SELECT c_custkey, unnest(list_concat(regexp_extract_all(line, rendering || '[{G.SUFFIXES}]'),
         list_filter(regexp_extract_all(line, substr(rendering, 1, 2) || '[{G.SUFFIXES}]'), lambda x: x <> rendering))) AS spelling FROM ln JOIN ch USING (media_id)
)
SELECT c_custkey, string_agg(DISTINCT spelling, '|' ORDER BY spelling) AS spellings FROM v GROUP BY c_custkey""")
def name_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("c_custkey", G.spelling_variants(F.col("line"), F.col("glossary")).alias("s"))
    return found.filter(F.size("s") > 0).select("c_custkey", F.array_join("s", "|").alias("spellings"))


@query(rf"""WITH {LINES}, n AS (
  SELECT c_custkey, count(*) AS n, any_value(gender) AS gender FROM ln JOIN ch USING (media_id) WHERE gender <> 'other' AND regexp_matches(source, '(?i)\b' || name || '\b') GROUP BY c_custkey
), r AS (
  SELECT c_custkey, line, n, CASE WHEN gender = 'male' AND contains(line, '她') AND NOT contains(line, '他') THEN replace(line, '她', '他')
                                  WHEN gender = 'female' AND contains(line, '他') AND NOT contains(line, '她') THEN replace(line, '他', '她') ELSE line END AS fixed FROM ln LEFT JOIN n USING (c_custkey)
)
SELECT c_custkey, CASE WHEN n = 1 THEN replace(replace(fixed, '嫁给', '结婚'), '娶', '结婚') ELSE line END AS fixed FROM r""")
def gender_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("c_custkey", G.fixed_gender(F.col("source"), F.col("line"), F.col("glossary")).alias("fixed"))


@query(rf"""WITH {LINES}, nm AS (
  SELECT media_id, replace(name, '_', ' ') AS name FROM ch
), sd AS (
  SELECT media_id, replace(source, '_', ' ') AS source FROM ln
), g AS (
  SELECT o.media_id, o.name, coalesce(sum(len(regexp_extract_all(source, '(?i)\b(o|ele|dele|rejeitado|sozinho|irmao|filho|tio)\b'))), 0)::BIGINT AS male,
         coalesce(sum(len(regexp_extract_all(source, '(?i)\b(a|ela|dela|rejeitada|sozinha|irma|filha|tia)\b'))), 0)::BIGINT AS female
  FROM nm o LEFT JOIN sd ON sd.media_id = o.media_id AND regexp_matches(source, '(?i)\b' || o.name || '\b') GROUP BY o.media_id, o.name
)
SELECT media_id, name, male, female, CASE WHEN male > female THEN 'male' WHEN female > male THEN 'female' ELSE 'unknown' END AS gender FROM g""")
def inferred_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genders of names of two words each."""
    apart = lambda c: F.translate(c, "_", " ")
    names = characters(spark, sf_dir).select("media_id", apart("name").alias("name"))
    return G.inferred_gender(lines(spark, sf_dir).select("media_id", apart("source").alias("text")), names)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN r ELSE floor((40 * r + 60 * j) / 100 + 0.5)::BIGINT END AS score
FROM (SELECT *, (round(o_totalprice * 100)::BIGINT + 5000) // 10000 AS r, o_custkey % 11 * 1000 AS j FROM orders)""")
def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.floor((F.round(F.col("o_totalprice") * 100).cast("bigint") + 5000) / 10000).cast("bigint")
    judge = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 11 * 1000)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", J.candidate_score(rule, judge).alias("score"))


@query(f"""WITH {WORDS_SQL}, l AS (
  SELECT media_id, start_ms AS t, 0 AS kind, segment_id AS id, upper(track) || ': ' || text AS line FROM segs
  UNION ALL SELECT media_id, t_ms, 1, row_number() OVER (PARTITION BY media_id ORDER BY t_ms), '[C' || row_number() OVER (PARTITION BY media_id ORDER BY t_ms) || ']' FROM cuts
)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, kind, id) - 1 AS n,
       '[' || CASE WHEN t >= 3600000 THEN (t // 3600000) || ':' ELSE '' END || lpad((t // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // 1000 % 60)::VARCHAR, 2, '0') || '] ' || line AS line FROM l""")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    words = V.words_once(spark, sf_dir)
    cuts = V.shot_cuts(words).withColumn("id", F.row_number().over(W.partitionBy("media_id").orderBy("t_ms")).cast("bigint"))
    return J.transcript_lines(V.segments(words), cuts)


#: Log lines of a recogniser, by the part's key.
LOG = ["Legenda salvo em: /out/{} ", "Idioma detectado: pt", "12 segmentos processados", "Transcrevendo audio", "Carregando modelo", "CUDA error: device not found"]


@query(f"""WITH l AS (SELECT p_partkey, p_name, CASE p_partkey % 6 {' '.join(f"WHEN {i} THEN replace('{t}', '{{}}', p_name)" for i, t in enumerate(LOG))} END AS line FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/out/' || p_name END AS output_path, CASE p_partkey % 6 WHEN 1 THEN 'pt' END AS language, CASE p_partkey % 6 WHEN 2 THEN 12 END::BIGINT AS segments,
       CASE p_partkey % 6 WHEN 3 THEN 'processing' WHEN 4 THEN 'preparing' END AS status, (p_partkey % 6 = 5 OR p_partkey % 7 = 0) AND p_partkey % 4 = 0 AS retry FROM l""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.replace(F.element_at(F.array(*[F.lit(t) for t in LOG]), (k % 6 + 1).cast("int")), F.lit("{}"), F.col("p_name"))
    code = F.when(k % 7 == 0, F.lit(J.CRASHES[0]))
    retry = J.retry_on_cpu(k % 2 == 1, k % 4 == 2, line, code)
    return V.table(spark, sf_dir, "part").select("p_partkey", *J.log_facts(line), retry.alias("retry"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 OR p_size % 5 <> 0 THEN 'resegment' WHEN p_partkey % 2 = 0 AND p_partkey % 7 = 0 THEN 'titles' END AS action,
       CASE WHEN p_size % 4 < 1 OR p_partkey % 4 < 1 THEN 'tracks begin at 1' WHEN p_size % 4 = p_partkey % 4 THEN 'film and mic are both track ' || (p_size % 4) END AS problem FROM part""")
def analysis_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    action = J.refresh_action([size % 3, size % 5], [F.lit(0), F.lit(0)], k % 2 == 0, k % 7 == 0)
    return V.table(spark, sf_dir, "part").select("p_partkey", action.alias("action"), J.tracks_problem(size % 4, k.cast("int") % 4).alias("problem"))


@query("""SELECT p.profile, count(v.profile) AS videos, greatest(0, 40 - count(v.profile)) AS remaining, any_value(trained) AND count(v.profile) >= 40 AS active
FROM (SELECT n_name AS profile, n_nationkey AS k, n_nationkey % 2 = 0 AS trained FROM nation) p LEFT JOIN (SELECT n_name AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 4000) v USING (profile) GROUP BY p.profile""")
def profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = V.table(spark, sf_dir, "nation")
    videos = V.table(spark, sf_dir, "customer").filter("c_acctbal > 4000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("profile"))
    return J.profile_status(videos, nation.select(F.col("n_name").alias("profile"), (F.col("n_nationkey") % 2 == 0).alias("trained")), 40)


@query("""SELECT o_orderpriority AS queue, o_orderkey AS job, row_number() OVER o - 1 AS place, coalesce(sum(o_custkey % 50) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts_at
FROM orders WHERE o_orderstatus <> 'F' WINDOW o AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("queued_at"), (F.col("o_orderstatus") == "F").alias("cancelled"), (F.col("o_custkey") % 50).alias("minutes")
    )
    return J.queue_order(jobs)


@query(rf"""WITH {WORDS_SQL}, c AS (
  SELECT media_id, segment_id AS card, start_ms - segment_id % 5 * 30 AS start_ms, end_ms + segment_id % 3 * 50 AS end_ms,
         CASE WHEN segment_id % 7 <> 3 THEN start_ms END AS speech_start, CASE WHEN segment_id % 7 <> 3 THEN end_ms END AS speech_end, text FROM segs
)
SELECT media_id, card, speech_start - start_ms AS lead_in_ms, end_ms - speech_end AS hold_ms,
       CASE WHEN lead(speech_start) OVER o IS NOT NULL AND speech_end IS NOT NULL THEN greatest(lead(speech_start) OVER o - speech_end, 0) END AS speech_gap_ms,
       CASE WHEN lead(speech_start) OVER o IS NOT NULL AND speech_end IS NOT NULL THEN lead(start_ms) OVER o - end_ms END AS user_gap_ms,
       len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '[^\pL\pN_]', '', 'g') <> '')) AS card_words, greatest(end_ms - start_ms, 0) AS card_ms
FROM c WINDOW o AS (PARTITION BY media_id ORDER BY card)""")
def timing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, said = F.col("segment_id"), F.col("segment_id") % 7 != 3
    cards = V.segments(V.words_once(spark, sf_dir)).select(
        "media_id", n.alias("card"), (F.col("start_ms") - n % 5 * 30).alias("start_ms"), (F.col("end_ms") + n % 3 * 50).alias("end_ms"),
        F.when(said, F.col("start_ms")).alias("speech_start"), F.when(said, F.col("end_ms")).alias("speech_end"), "text",
    )
    return J.timing_samples(cards)


def spoken_line(n: Column) -> Column:
    """A line for a sentence by its number: pieces of differing lengths behind a connective, with marks."""
    piece = lambda k: F.concat(F.repeat(F.substring(F.lit(SIGNS), (n + k) % 20 + 1, F.lit(1)), ((n * 7 + k * 5) % 13 + 1).cast("int")), F.substring(F.lit(X.CUT_MARKS), ((n + k) % 5 + 1).cast("int"), F.lit(1)))
    return F.concat(F.when(n % 3 == 0, "然后，").otherwise(""), F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n % 5), piece), ""))


@query(f"""WITH RECURSIVE {WORDS_SQL}, {PHRASES}, se AS (
  SELECT media_id, (phrase // 4)::BIGINT AS n, list({{'card': phrase::BIGINT, 's': start_ms, 'e': end_ms}} ORDER BY phrase) AS cards FROM phrases GROUP BY media_id, phrase // 4
), ln AS (
  SELECT *, CASE WHEN n % 3 = 0 THEN '然后，' ELSE '' END || array_to_string(list_transform(range(0, n % 5 + 1), lambda k: repeat(substr('{SIGNS}', (n + k) % 20 + 1, 1), (n * 7 + k * 5) % 13 + 1) || substr('，。？！；', (n + k) % 5 + 1, 1)), '') AS line FROM se
), tx AS (
  SELECT media_id, n, cards, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN substr(line, 4) ELSE line END AS line, CASE WHEN n % 3 = 0 THEN '然后' END AS opened FROM ln
), ch AS (
  SELECT *, regexp_extract_all(line, '[^，。？！；]*[，。？！；]|[^，。？！；]+') AS chunks FROM tx
), pk AS (
  SELECT media_id, n, 0 AS k, ''::VARCHAR AS cur, []::VARCHAR[] AS done, chunks FROM ch
  UNION ALL
  SELECT media_id, n, k + 1, CASE WHEN fits THEN cur || c ELSE c END, CASE WHEN fits OR cur = '' THEN done ELSE list_append(done, trim(cur, '，。；')) END, chunks
  FROM (SELECT *, chunks[k + 1] AS c, length(trim(cur || chunks[k + 1], '，。；')) <= 20 AS fits FROM pk WHERE k < len(chunks))
), pt AS (
  SELECT media_id, n, CASE WHEN trim(cur, '，。；') <> '' THEN list_append(done, trim(cur, '，。；')) ELSE done END AS lines FROM pk WHERE k = len(chunks) AND len(list_filter(chunks, lambda c: length(trim(c, '，。；')) > 20)) = 0
), ct AS (
  SELECT media_id, n, 0 AS k, 0::BIGINT AS said, 0::BIGINT AS cut, []::BIGINT[] AS cuts FROM pt
  UNION ALL
  SELECT media_id, n, k + 1, said2, best, list_append(cuts, best)
  FROM (SELECT c.*, said + length(lines[k + 1]) AS said2,
               list_min(list_transform(range(cut + 1, len(cards) - (len(lines) - k - 1) + 1), lambda j: {{'a': abs((cards[j + 1].s - cards[1].s) * list_sum(list_transform(lines, lambda x: length(x))) - (cards[len(cards)].e - cards[1].s) * (said + length(lines[k + 1]))), 'j': j}})).j AS best
        FROM ct c JOIN pt USING (media_id, n) JOIN ch USING (media_id, n) WHERE k < len(lines) - 1 AND len(cards) >= len(lines))
), fin AS (
  SELECT media_id, n, lines, cards, list_concat(list_concat([0], cuts), [len(cards)]) AS edges FROM ct JOIN pt USING (media_id, n) JOIN ch USING (media_id, n) WHERE k = len(lines) - 1
), ps AS (
  SELECT media_id, n, len(lines) AS size, unnest(list_transform(range(1, len(lines) + 1), lambda p: {{'p': p - 1, 'line': lines[p], 'a': cards[edges[p] + 1], 'b': cards[edges[p + 1]]}})) AS q FROM fin
), ok AS (
  SELECT *, min(q.b.e - q.a.s) OVER (PARTITION BY media_id, n) >= 1200 OR size = 1 AS fine FROM ps
)
SELECT tx.media_id, tx.n AS sentence, opened, q.p::INTEGER AS part, q.line AS line, q.a.card AS first, q.b.card AS last, q.a.s AS start_ms, q.b.e AS end_ms FROM tx LEFT JOIN ok ON ok.media_id = tx.media_id AND ok.n = tx.n AND fine""")
def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for every four phrases: the connective goes from every second one that has it, the rest is fitted to the phrases."""
    phrases = S.phrases(V.words_once(spark, sf_dir)).withColumn("sentence", F.expr("phrase DIV 4"))
    cards = F.array_sort(F.collect_list(F.struct(F.col("phrase").alias("card"), "start_ms", "end_ms")))
    rows = phrases.groupBy("media_id", "sentence").agg(cards.alias("cards")).withColumn("line", spoken_line(F.col("sentence")))
    opened = rows.withColumn("opened", X.opening_connective(F.col("line")))
    shorter = opened.withColumn("line", F.when((F.col("sentence") % 2 == 0) & F.col("opened").isNotNull(), X.without_connective(F.col("line"))).otherwise(F.col("line")))
    parts = X.fitted_lines(shorter, 20, 1200).select("media_id", "sentence", "opened", F.posexplode_outer("parts").alias("part", "p"))
    return parts.select("media_id", "sentence", "opened", "part", "p.*")
