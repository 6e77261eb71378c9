"""The queries opN_<name> and their SQL, by the operator's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, fm_index, lexical, line_windows, mixing, near_dup, ppm, suffix_sort, syncmers, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document, named by its least doc_id."""
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=5, threshold=0.8)
    return out.select("doc_id", "class_id", "n_links", "nearest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a machine that never saw the labels of the held-out part."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), out_of=(4, 2))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document when 13-word windows of earlier documents are taken out."""
    out = fm_index.remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram log10 probabilities of each document, learned from six parts in seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ppm.count(docs.where(~ppm.held_out(F.col("doc_id"))), order=5)
    tree = ppm.edges(counts, order=5)
    out = ppm.scores(docs, counts, ppm.fit(counts, order=5, tree=tree), deep=ppm.Deep(tree, order=5))
    return out.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document, beside those of an edited one and of the next."""
    out = syncmers.compared(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.shown(F.col("anchors")).alias("fingerprint"),
        syncmers.shown(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of each document when later occurrences of three-line windows are taken out."""
    out = line_windows.dedup_lines(table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of each document when 200-byte strings that repeat are taken out."""
    out = suffix_sort.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 1, 2, 3 takes of each document."""
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3, seed=1)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 10-word windows of benchmark items."""
    out = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), width=10)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and trained text of each conversation, read back from its formatted text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    out = chat.format_chat(turns.unionByName(more))
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document and the row of it that stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of each embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM split),
windows AS (
  SELECT doc_id, i, list(word) OVER w AS w, count(*) OVER w AS n
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
judged AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY hash(w), w) AS first_doc FROM windows WHERE n = 13),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM judged WHERE first_doc < doc_id),
kept AS (
  SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT s.doc_id, len(s.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no
  FROM documents),
full_lines AS (
  SELECT doc_id, no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, no, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c,
         lead(no) OVER w AS no2, lead(no, 2) OVER w AS no3
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
later AS (
  SELECT doc_id, no, no2, no3, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, no) AS place
  FROM windows WHERE c IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([no, no2, no3]) AS no FROM later WHERE place > 1),
kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.no) AS kept
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.no = g.no WHERE g.no IS NULL GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id) f USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
dealt AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight, (3 * source_size)::HUGEINT AS most FROM sources),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS place FROM dealt),
rest AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) AS words, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS shares
  FROM ordered WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (
  SELECT *, most * shares > weight * words AS free FROM rest),
shared AS (
  SELECT arg_min(words::DOUBLE / shares::DOUBLE, place) AS level FROM levelled WHERE free),
planned AS (
  SELECT source, source_size, CASE WHEN free THEN weight::DOUBLE * level ELSE most::DOUBLE END AS target FROM levelled LEFT JOIN shared ON true),
rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM rated
"""

OP9_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (
  SELECT item_id, words, least(len(words), 10) AS size FROM asked WHERE len(words) > 0),
windows AS (
  SELECT item_id, size, list_slice(words, i, i + size - 1) AS w
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
places AS (
  SELECT doc_id, size, i, list_slice(words, i, i + size - 1) AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM lowered, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
found AS (
  SELECT p.doc_id, p.size, p.i, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.w = x.w),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT l.doc_id, len(l.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS r,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS t FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '') AS loss,
         sum(13 + length(r) + length(t))::BIGINT AS formatted_chars
  FROM written GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sized AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
marked AS (
  SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM sized, whole),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN marked USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

OP12_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1 AS kept, sha256(text) AS text_sha256
FROM own WINDOW w AS (PARTITION BY text)
"""

QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_string_kernel": op2_string_kernel,
    "op3_fm_index": op3_fm_index,
    "op4_ppm": op4_ppm,
    "op5_syncmers": op5_syncmers,
    "op6_line_windows": op6_line_windows,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat": op10_chat,
    "op11_bucket_search": op11_bucket_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_fm_index": OP3_SQL,
    "op6_line_windows": OP6_SQL,
    "op8_source_mix": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_chat": OP10_SQL,
    "op11_bucket_search": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
}
