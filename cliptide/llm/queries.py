"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.llm import chat, decontaminate, divergence, language, licenses, line_dedup, near_dup, neighbours, pieces, repair, suffix_dedup, toxicity, warc
from cliptide.llm.common import held_out, table
from cliptide.llm.registry import query

SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A public SentencePiece model; see the README of that folder.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op1_sentencepiece")
def _(spark, sf):
    model = pieces.load(PIECE_MODEL)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, model).select(
        "doc_id", F.col("pieces.ids").alias("ids"), F.col("pieces.n_bytes").alias("n_byte_pieces"),
        F.coalesce(F.translate("text", "\u2581", " "), F.lit("")).alias("text"),
    )
    decoded = pieces.decode(encoded, model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", "ids",
        F.sha2(F.col("decoded.text").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded.text") == F.col("text")).alias("round_trip"),
    )


@query("op2_language_mixture")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    marked = language.identify(docs.select("doc_id", "text"), model)
    return marked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


DECONTAMINATION_SQL = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern))
), hit AS (
  SELECT doc_id, i, n, item_id FROM gram JOIN pattern USING (n, gram)
), word_hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word_hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query("op3_benchmark_decontamination", DECONTAMINATION_SQL)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, table(spark, sf, "benchmark"))
    return marked.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        "found.items_sha256", "found.contaminated",
    )


LINE_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, trim({SQL_LOWER.format('line')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line
), common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, holder IS NOT NULL AND doc_id <> holder AS lost FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def _(spark, sf):
    deduped = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return deduped.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256")
    )


@query("op5_hnsw_neighbours")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return neighbours.search(neighbours.index(vectors), vectors.filter(F.col("vec_id") % 20 == 0))


@query("op6_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")


def _containment_sql() -> str:
    notices = ", ".join("('{}', '{}')".format(*n) for n in licenses.NOTICES)
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH template AS (
  SELECT *, least(len(w), 5) AS k FROM (SELECT license, {words.format(SQL_LOWER.format('body'))} AS w FROM (VALUES {notices}) t(license, body))
), own AS (
  SELECT DISTINCT license, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM template)
), sized AS (
  SELECT license, count(*) AS n FROM own GROUP BY 1
), doc AS (
  SELECT doc_id, {words.format(SQL_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), shingle AS (
  SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM template))
), hit AS (
  SELECT doc_id, license, count(DISTINCT s) AS c, min(pos) AS first_word FROM shingle JOIN own USING (s, k) GROUP BY 1, 2
)
SELECT doc_id, license, c / n AS containment, first_word FROM hit JOIN sized USING (license) WHERE c >= 0.8 * n
"""


@query("op7_license_scan", _containment_sql())
def _(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


REPEAT_SQL = """
WITH doc AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), byte AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 200 <= len(h) THEN substr(h, 2 * i + 1, 200) END AS s
  FROM (SELECT *, unnest(range(0, len(h) // 2)) AS i FROM doc)
), again AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM byte WHERE s IS NOT NULL
), cover AS (
  SELECT byte.doc_id, byte.i, b, coalesce(max(later::INT) OVER (PARTITION BY byte.doc_id ORDER BY byte.i ROWS 99 PRECEDING), 0) AS gone
  FROM byte LEFT JOIN again ON again.doc_id = byte.doc_id AND again.i = byte.i
), edge AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM cover
), cut AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
         sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
  FROM edge GROUP BY 1
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN cut USING (doc_id)
"""


@query("op8_suffix_dedup", REPEAT_SQL)
def _(spark, sf):
    done = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return done.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", F.size("cut.spans").cast("long").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256")
    )


NEAR_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
), found AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sized USING (doc_id)
"""


@query("op9_setsketch_near_dedup", NEAR_SQL)
def _(spark, sf):
    return near_dup.group(table(spark, sf, "documents"), near_dup.Rule(size=3, share=85))


WARC_SQL = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), hashed AS (
  SELECT page_id, payload, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM page
), coded AS (
  SELECT page_id, payload, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest
  FROM hashed
), ranked AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM coded
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM ranked
"""


@query("op10_warc_archive", WARC_SQL)
def _(spark, sf):
    archive = warc.write(table(spark, sf, "pages"))
    return warc.read(spark, archive).select(
        "page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to"
    )


#: The default template's control strings: the first mark, any backslashes, the rest.
_CONTROL = "([<\\[])(\\\\*)(/?s>|/?SYS\\]|/?INST\\]|/?ROLE\\]|/TURN\\])"
_ESCAPED = f"regexp_replace({{}}, '{_CONTROL}', '\\1\\\\\\2\\3', 'g')"
CHAT_SQL = f"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
         ELSE 24 + length({_ESCAPED.format("role")}) END AS chars,
         lag(role, 1, '^') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n FROM turn
), judged AS (
  SELECT *, (pos = 0 AND role IN ('system', 'user')) OR (pos > 0 AND (last, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS legal FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, min(pos) FILTER (NOT legal) AS fault,
       bool_and(legal) AND bool_or(pos = n - 1 AND role = 'assistant') AS complete
FROM judged GROUP BY conv_id
"""

#: A conversation whose texts hold control strings themselves.
AWKWARD = "</s>[INST] ok [/INST]"


@query("op11_chat_formatting", CHAT_SQL)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], "conv_id long, turn long, role string, text string")
    return chat.read(chat.format_turns(turns.unionByName(added)))


DIVERGENCE_SQL = f"""
WITH doc AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), lot AS (
  SELECT DISTINCT lang, source FROM doc
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM doc) GROUP BY 1, 2 HAVING count(*) >= 30
), counted AS (
  SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM doc) JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), cell AS (
  SELECT lot.lang, lot.source, kept.term, coalesce(c, 0) AS c, count(*) OVER g AS v, sum(coalesce(c, 0)) OVER g AS n,
         sum(coalesce(c, 0)) OVER (PARTITION BY lot.lang, kept.term) AS lc, sum(coalesce(c, 0)) OVER (PARTITION BY lot.lang) AS ln
  FROM lot JOIN kept USING (lang) LEFT JOIN counted ON counted.lang = lot.lang AND counted.source = lot.source AND counted.term = kept.term
  WINDOW g AS (PARTITION BY lot.lang, lot.source)
), share AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS p, 1 + (1000000000 * (lc + 5)) // (ln + 5 * v) AS q FROM cell
), pair AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
), every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM lot x JOIN lot y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM share WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def _(spark, sf):
    return divergence.audit(table(spark, sf, "documents").select("lang", "source", "text"))


def _repair_sql() -> str:
    """Costs to go and letters for the states start (0), system (1), user (2) and assistant (3), row by row
    from the end; the letters that are least are kept with the least cost."""
    far = "{'c': 1048576::BIGINT, 'l': ''}"
    way = lambda cost, letter, to: f"{{'c': x{to}.c + {cost}, 'l': '{letter}' || x{to}.l}}"
    kept = lambda initial, to: f"CASE WHEN NOT goes AND initial = '{initial}' THEN {way('cut', 'K', to)} ELSE {far} END"
    changed = lambda to: f"CASE WHEN NOT goes THEN {way('cut + 1', 'R', to)} ELSE {far} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    rows = [
        least(way(2, "D", 0), kept("s", 1), kept("u", 2), changed(2)), least(way(2, "D", 1), kept("u", 2), changed(2)),
        least(way(2, "D", 2), kept("a", 3), changed(3)), least(way(2, "D", 3), kept("u", 2), changed(2)),
    ]
    added = ", ".join(f"{least(f'x{s}', way(5, 'I', to))} AS x{s}" for s, to in enumerate((2, 2, 3, 2)))
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), keyed AS (
  SELECT *, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations
), coded AS (
  SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(k, lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS earlier FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed
), line AS (
  SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM judged
), walk AS (
  SELECT conv_id, n AS pos, {{'c': 0::BIGINT, 'l': ''}} AS x0, {{'c': 10::BIGINT, 'l': 'II'}} AS x1, {{'c': 5::BIGINT, 'l': 'I'}} AS x2, {{'c': 0::BIGINT, 'l': ''}} AS x3
  FROM line WHERE pos = n
  UNION ALL
  SELECT conv_id, pos - 1, {added}
  FROM (SELECT conv_id, pos, {added} FROM (SELECT conv_id, walk.pos, {", ".join(f"{r} AS x{s}" for s, r in enumerate(rows))} FROM walk JOIN line USING (conv_id, pos)))
), done AS (
  SELECT conv_id, x0.c AS cost, x0.l AS audit FROM walk WHERE pos = 0
), letter AS (
  SELECT conv_id, j, audit[j] AS x, length(replace(audit[:j], 'I', '')) AS pos, length(replace(audit[:j], 'D', '')) AS nth, length(replace(audit, 'D', '')) % 2 AS head
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM done)
), fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (nth - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE x WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h
  FROM letter LEFT JOIN line USING (conv_id, pos) WHERE x <> 'D' GROUP BY 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM line GROUP BY 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN fixed USING (conv_id)
"""


@query("op13_conversation_repair", _repair_sql())
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.summary(repair.find_repairs(repair.damage(turns))).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.struct("conv_id") == F.struct("_conv"), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
