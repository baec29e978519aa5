"""The registered corpus queries (opN_<name>) and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import dialogue, embeddings, htmltext, jaccard, language, licences, mixing, periodic, qualityclass, qualityrules, sentencepieces, sharding, warc
from lumengrid.llm.common import crc_fold, materialise, shared_dir, table

#: Of crc32(doc_id) mod 4, the fold that no model learns from.
HELD_OUT = 2
#: From this score on a document counts as good.
GOOD = 0.7


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s),
r AS (SELECT *, 2 * source_size::DOUBLE AS cap, 2 * source_size::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT l.source, l.no, l.source_size, least(l.cap, coalesce(l.weight * b.level, l.cap)) AS target FROM l LEFT JOIN b ON true),
q AS (
  SELECT d.*, t.no, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY t.no ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.*, copy, (before + size + copy * source_size)::DOUBLE / target AS finish
  FROM q, (SELECT unnest([0, 1]) AS copy) WHERE size > 0 AND target > 0),
e AS (SELECT *, sum(size) OVER (ORDER BY finish, copy, no, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c),
n AS (SELECT doc_id, no, size, count(*) AS copies FROM e WHERE upto <= 1.5 * (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(n.copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.no = n.no AND q.size = n.size
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.where(crc_fold("doc_id") != HELD_OUT))
    out = language.predict(docs, model, carry=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple[qualityclass.Discriminant, DataFrame]:
    """Fit outside the held-out fold; also returns the materialised statistics of all documents."""
    stats = materialise(qualityclass.statistics(docs.select("doc_id", "text"), carry=["doc_id"]))
    labelled = stats.where(crc_fold("doc_id") != HELD_OUT).join(labels.select("doc_id", "quality"), "doc_id")
    return qualityclass.fit(labelled), stats


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, stats = quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = qualityclass.score(stats, model, ["doc_id"])
    held = F.coalesce(crc_fold("doc_id") == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its notices, how many are worded exactly, and the distinct licences by name."""
    out = licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["licence"]))), ";")
    exact = F.size(F.filter("notices", lambda n: n["exact"])).cast("long")
    return out.select("doc_id", F.size("notices").cast("long").alias("n_notices"), exact.alias("n_exact"), names.alias("licences"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS s FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b, shared = na AND shared = nb AS equal FROM c WHERE shared >= 0.8::DOUBLE * (na + nb - shared)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach),
g AS (SELECT id, min(reach) AS group_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links, min(b) FILTER (equal) AS smallest FROM p GROUP BY a)
SELECT d.doc_id, least(d.doc_id, n.smallest) AS class_id, coalesce(n.n_links, 0)::BIGINT AS n_links, g.group_id, g.group_id = d.doc_id AS kept
FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.a = d.doc_id
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qualityrules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.withColumnRenamed("id", "doc_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98 END),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach),
g AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, g.component_id, g.component_id = e.vec_id AS kept
FROM embeddings e JOIN g ON g.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lumengrid-warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    captures = materialise(warc.assemble(materialise(warc.read(spark, path, payload=False))))
    page_id = F.col("metadata.fields")["captureId"].cast("long")
    captures = warc.resolve_revisits(captures, page_id)
    size = F.coalesce("response.payload_bytes", F.col("metadata.fields")["payloadBytes"].cast("long"))
    return captures.select(page_id.alias("page_id"), size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to")


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1), '' ORDER BY k) AS payload_digest
      FROM d, (SELECT unnest(range(32)) AS k) GROUP BY page_id)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d JOIN b USING (page_id)
"""


def encoded_digests(docs: DataFrame) -> DataFrame:
    out = sentencepieces.encode(docs, piece_model(), carry=["doc_id"], outputs=("n_tokens", "ids", "spans", "decoded"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("spans", 256).alias("spans_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: each cut is where the bytes below are nearest to its share."""
    out = sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc(text: str) -> str:
    """SQL of the CRC-32 of a string's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)"
    step = "xor(c >> 8, list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b) & 255))"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT doc_id, substr(md5(body), 1, 16) AS k, octet_length(encode(body)) + 1 AS size, {crc('body')} AS text_crc32 FROM d),
b AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total FROM s WINDOW o AS (ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(7, (8 * (2 * before + size)) // (2 * total))::INT AS shard FROM b)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows dropped, emptied, cut off, repeated or given to the user, by crc32 of conv_id:turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("h <> 0").withColumns({"text": text, "role": F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat("h", F.when(F.col("h") == 3, 2).otherwise(1)))).drop("col")


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = dialogue.audit(damaged(turns)).withColumnRenamed("conv_id", "__conv")
    whole = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op12_sql() -> str:
    """The same by one pass over a conversation's rows: for each state the cheapest history, as cost, edits and lines in one string."""
    sep = "chr(1)"
    add = lambda x, cost, edit, line=None: f"(CASE WHEN {x} <> '~' THEN lpad(((split_part({x}, {sep}, 1))::INT + {cost})::VARCHAR, 9, '0') || {sep} || split_part({x}, {sep}, 2) || '{edit}' || {sep} || substr({x}, length(split_part({x}, {sep}, 1)) + length(split_part({x}, {sep}, 2)) + 3)" + (f" || chr(10) || {line}" if line else "") + " ELSE '~' END)"
    insert = lambda q: "SELECT * REPLACE (" + f"least({q}2, {add(f'{q}0', 2, 'I', chr(39) + 'user:' + chr(39))}, {add(f'{q}1', 2, 'I', chr(39) + 'user:' + chr(39))}, {add(f'{q}3', 2, 'I', chr(39) + 'user:' + chr(39))}) AS {q}2, least({q}3, {add(f'{q}2', 2, 'I', chr(39) + 'assistant:' + chr(39))}) AS {q}3)"
    turn = {0: add("q0", 3, "D"), 1: f"least({add('q1', 3, 'D')}, CASE WHEN NOT must AND ini = 's' THEN {add('q0', 'cut', 'K', 'line')} ELSE '~' END)"}
    say = lambda state, befores, char, role: f"least({add(f'q{state}', 3, 'D')}, " + ", ".join(f"CASE WHEN must THEN '~' WHEN ini = '{char}' THEN {add(b, 'cut', 'K', 'line')} ELSE {add(b, 'cut + 2', 'R', chr(39) + role + ':' + chr(39) + ' || text')} END" for b in befores) + ")"
    turn[2] = say(2, ["q0", "q1", "q3"], "u", "user")
    turn[3] = say(3, ["q2"], "a", "assistant")
    head = f"'000000000' || {sep} || {sep}"
    steps = f"SELECT r.conv_id, r.pos + 1 AS pos, " + ", ".join(f"{turn[k]} AS q{k}" for k in range(4)) + " FROM {src} r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1"
    closed = lambda src: insert("q") + f" FROM ({insert('q')} FROM ({insert('q')} FROM {src}))"
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {crc('k')} % 20 AS h FROM o),
g AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS pos, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM g),
m AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, substr(role, 1, 1) AS ini FROM n),
f AS MATERIALIZED (SELECT conv_id, pos, turn, role, text, ini, blank, again, blank OR again AS must, (NOT blank AND NOT again AND right(said, 1) NOT IN ('.', '!', '?'))::INT AS cut, role || ':' || text AS line, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM m),
r AS (
  SELECT conv_id, 0::BIGINT AS pos, {head} AS q0, '~' AS q1, '~' AS q2, '~' AS q3 FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL {steps.replace("{src}", "(" + closed("r") + ")")}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS place FROM r) WHERE place = 1),
e AS (SELECT conv_id, least(q0, q3) AS x FROM ({closed('l')})),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut = 1) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       split_part(x, {sep}, 1)::BIGINT AS cost, split_part(x, {sep}, 2) AS audit, sha256(substr(x, length(split_part(x, {sep}, 1)) + length(split_part(x, {sep}, 2)) + 4)) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP12_SQL = _op12_sql()


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of doc_id, repeats some of its words from a word on to its end; a null id repeats nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumns({"__on": F.coalesce(h % 10 == 0, F.lit(False)), "__g": F.floor(h / 10)})
    rows = docs.withColumn("__words", F.when(F.col("__on"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n = F.size("__words")
    rows = rows.withColumn("__a", F.when(n > 0, F.col("__g") % n).cast("int"))
    rows = rows.withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("__a") - 1), lambda i: F.get("__words", F.col("__a") + i % F.col("__p")))
    again = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return rows.withColumn("text", F.when(n > 0, again).otherwise(F.col("text"))).drop("__on", "__g", "__words", "__a", "__p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(planted(table(spark, sf_dir, "documents", "doc_id", "text")), carry=("doc_id",))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(r.cast("array<string>"), ","), F.lit("\n"))), "")
    greatest = ("start", "length", "period", "exponent_milli")
    return found.select("doc_id", "n_runs", *greatest, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_text": op2_html_text,
    "op3_language": op3_language,
    "op4_licences": op4_licences,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_embedding_near_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op11_sharding": OP11_SQL, "op12_dialogue_repair": OP12_SQL}
