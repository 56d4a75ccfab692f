"""The registered queries of this package: one per operator, with SQL where SQL can state the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import (
    benchmark_hits,
    byte_bpe,
    fingerprints,
    line_spread,
    near_copies,
    packing,
    phrases,
    pii_spans,
    quality,
    quotes,
    site_templates,
    top_inner,
    turn_repair,
)
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table

REGISTRY = Registry()


@REGISTRY.query(
    "op7_top_inner",
    """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.ints) = len(q.ints) WHERE q.vec_id % 100 = 0
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op7_top_inner(spark, folder):
    vectors = top_inner.integer_vectors(table(spark, folder, "embeddings"))
    return top_inner.top_inner(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@REGISTRY.query("op10_packing")
def op10_packing(spark, folder):
    return packing.pack(packing.pieces(table(spark, folder, "documents"), packing.VOCABULARY))


@REGISTRY.query("op5_personal_data")
def op5_personal_data(spark, folder):
    documents = table(spark, folder, "documents")
    return pii_spans.digest(pii_spans.find_spans(documents, pii_spans.fit(documents)))


@REGISTRY.query("op8_near_copies")
def op8_near_copies(spark, folder):
    return near_copies.near_copies(table(spark, folder, "documents"), size=4, percent=80)


@REGISTRY.query("op9_quality")
def op9_quality(spark, folder):
    documents = table(spark, folder, "documents")
    model = quality.fit(documents, quality.training_labels(table(spark, folder, "labels")))
    scored = quality.score(documents, model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@REGISTRY.query(
    "op2_line_spread",
    r"""
    WITH bodies AS (
      SELECT doc_id, source, list_transform(string_split(coalesce(text, ''), chr(10)),
             lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(12) || chr(11))) AS body FROM documents
    ), lines AS (
      SELECT doc_id, coalesce('s' || source, '-') AS site, sha256(array_to_string(list_filter(body, lambda x: x <> ''), chr(10))) AS sequence,
             unnest(body) AS line, generate_subscripts(body, 1) AS pos FROM bodies
    ), spread AS (
      SELECT line, arg_min(sequence, doc_id) AS first_sequence FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8
    ), marked AS (
      SELECT l.doc_id, l.pos, l.sequence = s.first_sequence AND row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY l.pos) = 1 AS keeps
      FROM lines l JOIN spread s ON s.line = l.line
    ), gone AS (SELECT doc_id, list(pos) FILTER (WHERE NOT keeps) AS removed FROM marked GROUP BY doc_id
    ), joined AS (
      SELECT d.doc_id, d.text, string_split(coalesce(d.text, ''), chr(10)) AS body, coalesce(g.removed, []) AS removed
      FROM documents d LEFT JOIN gone g USING (doc_id)
    )
    SELECT doc_id, CAST(len(body) AS BIGINT) AS n_lines, len(removed) AS n_removed,
           CASE WHEN len(removed) = 0 THEN text
                ELSE array_to_string(list_filter(body, lambda x, i: NOT list_contains(removed, i)), chr(10)) END AS text
    FROM joined
    """,
)
def op2_line_spread(spark, folder):
    cleaned = line_spread.without_spread_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


@REGISTRY.query("op3_byte_bpe")
def op3_byte_bpe(spark, folder):
    codes = byte_bpe.encode(table(spark, folder, "documents"), keep_ids=False)
    return codes.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@REGISTRY.query("op4_main_text")
def op4_main_text(spark, folder):
    return site_templates.main_text(table(spark, folder, "pages"))


@REGISTRY.query("op1_fingerprints")
def op1_fingerprints(spark, folder):
    told = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@REGISTRY.query("op6_reply_order")
def op6_reply_order(spark, folder):
    return quotes.reply_order(table(spark, folder, "conversations"))


@REGISTRY.query(
    "op11_turn_repair",
    r"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
      FROM conversations
    ), drawn AS (
      SELECT *, xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)),
               lambda crc, byte: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
               4294967295)) % 20 AS kind
      FROM keyed
    ), harmed AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM drawn WHERE kind <> 0
    ), placed AS (
      SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, role, text, left(role, 1) AS initial,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
      FROM harmed
    ), turns AS (
      SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
             i > 1 AND lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
      FROM (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again FROM placed)
    ), counts AS (
      SELECT g, min(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
             count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
      FROM turns GROUP BY g
    ), paths AS (
      SELECT g, CAST(0 AS BIGINT) AS i, {'c': 0, 'p': ''} AS z, {'c': 99999999, 'p': ''} AS s, {'c': 99999999, 'p': ''} AS u, {'c': 99999999, 'p': ''} AS a
      FROM counts
      UNION ALL
      SELECT g, i, {'c': z.c + 3, 'p': z.p || 'D'},
             CASE WHEN stays AND initial = 's' THEN list_min([{'c': s.c + 3, 'p': s.p || 'D'}, {'c': z.c + x, 'p': z.p || 'K'}])
                  ELSE {'c': s.c + 3, 'p': s.p || 'D'} END,
             CASE WHEN NOT stays THEN {'c': u.c + 3, 'p': u.p || 'D'}
                  ELSE list_min([{'c': u.c + 3, 'p': u.p || 'D'}, {'c': z.c + k, 'p': z.p || ku}, {'c': s.c + k, 'p': s.p || ku}, {'c': a.c + k, 'p': a.p || ku}]) END,
             CASE WHEN NOT stays THEN {'c': a.c + 3, 'p': a.p || 'D'}
                  ELSE list_min([{'c': a.c + 3, 'p': a.p || 'D'}, {'c': u.c + l, 'p': u.p || la}]) END
      FROM (
        SELECT g, i, z, s, u, list_min([a, {'c': u.c + 2, 'p': u.p || 'I'}]) AS a, stays, initial, x,
               CASE WHEN initial = 'u' THEN x ELSE 2 + x END AS k, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS ku,
               CASE WHEN initial = 'a' THEN x ELSE 2 + x END AS l, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS la
        FROM (
          SELECT t.g, t.i, z, s, a, NOT (blank OR dup) AS stays, initial, CASE WHEN cut THEN 1 ELSE 0 END AS x,
                 list_min([u, {'c': z.c + 2, 'p': z.p || 'I'}, {'c': s.c + 2, 'p': s.p || 'I'}, {'c': a.c + 2, 'p': a.p || 'I'}]) AS u
          FROM paths p JOIN turns t ON t.g = p.g AND t.i = p.i + 1
        )
      )
    ), ends AS (
      SELECT g, list_min([z, a, {'c': u.c + 2, 'p': u.p || 'I'}, {'c': s.c + 4, 'p': s.p || 'II'}]) AS best
      FROM paths JOIN counts USING (g) WHERE i = n
    ), letters AS (
      SELECT g, spot, best.p[spot] AS letter FROM (SELECT g, best, unnest(range(1, len(best.p) + 1)) AS spot FROM ends)
    ), told AS (
      SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS nth
      FROM letters WINDOW w AS (PARTITION BY g ORDER BY spot)
    ), opened AS (
      SELECT o.g, bool_or(o.letter = 'K' AND o.nth = 1 AND t.initial = 's') AS system FROM told o LEFT JOIN turns t ON t.g = o.g AND t.i = o.i GROUP BY o.g
    ), lines AS (
      SELECT o.g, o.spot, CASE WHEN letter = 'K' THEN t.role WHEN (nth + CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                        || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END AS line
      FROM told o JOIN opened USING (g) LEFT JOIN turns t ON t.g = o.g AND t.i = o.i WHERE letter <> 'D'
    ), hashed AS (SELECT g, string_agg(line, chr(10) ORDER BY spot) AS body FROM lines GROUP BY g
    ), result AS (
      SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.p AS audit, sha256(coalesce(body, '')) AS repaired_sha256
      FROM counts JOIN ends USING (g) LEFT JOIN hashed USING (g)
    )
    SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
           coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN result r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
)
def op11_turn_repair(spark, folder):
    return turn_repair.repaired_after_damage(table(spark, folder, "conversations"))


@REGISTRY.query(
    "op12_benchmark_hits",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents
    ), i AS (
      SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark
    ), windows AS (
      SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS s
      FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
    ), places AS (
      SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN (SELECT DISTINCT k FROM windows) ON len(w) >= k)
    ), found AS (SELECT r, p, k, item FROM places JOIN windows USING (k, s)
    ), covered AS (
      SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r
    ), held AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
    """,
)
def op12_benchmark_hits(spark, folder):
    return benchmark_hits.digest(benchmark_hits.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@REGISTRY.query(
    "op13_phrases",
    r"""
    WITH d AS (
      SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM words) GROUP BY lang, x
    ), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
    ), g2 AS (
      SELECT lang, x, y, count(*) AS a
      FROM (SELECT lang, w[p] AS x, w[p + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS p FROM words))
      GROUP BY lang, x, y HAVING count(*) >= 10
    ), g3 AS (
      SELECT lang, x, y, z, count(*) AS a
      FROM (SELECT lang, w[p] AS x, w[p + 1] AS y, w[p + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS p FROM words))
      GROUP BY lang, x, y, z HAVING count(*) >= 10
    ), s2 AS (
      SELECT g.lang, g.x, g.y, g.a, p.f AS l, q.f AS r,
             CAST(CAST(g.a AS HUGEINT) * g.a * 1000000 // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
      FROM g2 g JOIN f1 p ON p.lang = g.lang AND p.x = g.x JOIN f1 q ON q.lang = g.lang AND q.x = g.y
    ), cuts AS (
      SELECT g.lang, g.x, g.y, g.z, g.a, p.f AS l1, yz.a AS r1, xy.a AS l2, q.f AS r2,
             CAST(CAST(g.a AS HUGEINT) * g.a * 1000000 // (CAST(p.f AS HUGEINT) * yz.a) AS BIGINT) AS score1,
             CAST(CAST(g.a AS HUGEINT) * g.a * 1000000 // (CAST(xy.a AS HUGEINT) * q.f) AS BIGINT) AS score2
      FROM g3 g JOIN f1 p ON p.lang = g.lang AND p.x = g.x JOIN f1 q ON q.lang = g.lang AND q.x = g.z
      JOIN g2 xy ON xy.lang = g.lang AND xy.x = g.x AND xy.y = g.y JOIN g2 yz ON yz.lang = g.lang AND yz.x = g.y AND yz.y = g.z
    ), longer AS (
      SELECT lang, x, y, max(a) AS held
      FROM (SELECT lang, x, y, a FROM g3 UNION ALL SELECT lang, y AS x, z AS y, a FROM g3) GROUP BY lang, x, y
    ), standing AS (
      SELECT s.lang, concat_ws(' ', s.x, s.y) AS phrase, s.a, s.l, s.r, s.score
      FROM s2 s LEFT JOIN longer h ON h.lang = s.lang AND h.x = s.x AND h.y = s.y WHERE h.held IS NULL OR 100 * h.held < 50 * s.a
      UNION ALL
      SELECT lang, concat_ws(' ', x, y, z), a, CASE WHEN score1 <= score2 THEN l1 ELSE l2 END,
             CASE WHEN score1 <= score2 THEN r1 ELSE r2 END, least(score1, score2) FROM cuts
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM standing
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13_phrases(spark, folder):
    return phrases.mined(table(spark, folder, "documents"))


@REGISTRY.query("pipeline")
def pipeline(spark, folder):
    """No SQL states the stages but line dedup: ``corpus_pipeline.ORACLE_SQL`` is None."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
