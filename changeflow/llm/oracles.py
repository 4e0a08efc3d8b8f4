"""SQL of the collocations and the Merkle manifest, as DuckDB runs it."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS = f"""
    WITH piece AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
    place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    gram AS (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM place, (VALUES (1), (2), (3)) sizes(k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase),
    whole AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
    cut AS (SELECT *, unnest(range(1, k)) AS head_words FROM cand),
    scored AS (
        SELECT cut.lang, cut.k, cut.phrase, a, head_words, h.f AS l, t.f AS r,
               CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
        FROM cut
        JOIN f h ON h.lang = cut.lang AND h.k = head_words AND h.phrase = array_to_string(w[1 : head_words], ' ')
        JOIN f t ON t.lang = cut.lang AND t.k = cut.k - head_words AND t.phrase = array_to_string(w[head_words + 1 :], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head_words) = 1),
    inside AS (
        SELECT lang, part, max(a) AS longest FROM (
            SELECT lang, a, array_to_string(w[1 : 2], ' ') AS part FROM cand WHERE k = 3
            UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM cand WHERE k = 3) x
        GROUP BY lang, part),
    kept AS (
        SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.part = best.phrase AND best.k = 2
        WHERE longest IS NULL OR 100 * longest < 50 * a)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN whole ON whole.lang = kept.lang
    QUALIFY rank <= 2000"""


def _framed(*columns: str) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts)


_STEP = "sha256(string_agg(h, '' ORDER BY p))"

MANIFEST = f"""
    WITH RECURSIVE bits(i, v, k) AS (
        SELECT i, i, 0 FROM range(256) x(i)
        UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    sums AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    digits AS (
        SELECT doc_id, lang, source, n_chars, text,
               list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)) AS b
        FROM documents),
    checked AS (
        SELECT digits.* EXCLUDE (b),
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
                   CAST(4294967295 AS BIGINT)) AS crc
        FROM digits, sums),
    hashed AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
               sha256({_framed("doc_id", "source", "lang", "n_chars", f"(CASE WHEN crc % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END)")}) AS given
        FROM checked),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
               count(*) OVER (PARTITION BY tree) AS n FROM hashed),
    node(level, tree, p, n, h) AS (
        SELECT 0, tree, p, n, leaf FROM leaves
        UNION ALL
        SELECT any_value(level) + 1, tree, p // 8, (any_value(n) + 7) // 8, {_STEP} FROM node WHERE n > 1 GROUP BY tree, p // 8),
    over AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM node WHERE n = 1),
    top(level, p, n, h) AS (
        SELECT 0, p, n, subroot FROM over
        UNION ALL
        SELECT any_value(level) + 1, p // 8, (any_value(n) + 7) // 8, {_STEP} FROM top WHERE n > 1 GROUP BY p // 8),
    beside AS (
        SELECT a.level, a.tree, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before,
               coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
        FROM node a JOIN node b ON a.level = b.level AND a.tree = b.tree AND a.p // 8 = b.p // 8 WHERE a.n > 1
        GROUP BY a.level, a.tree, a.p),
    above AS (
        SELECT a.level, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before,
               coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
        FROM top a JOIN top b ON a.level = b.level AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY a.level, a.p),
    walk(level, tree, leaf_p, p, h, proof) AS (
        SELECT 0, tree, p, p, given, '' FROM leaves
        UNION ALL
        SELECT w.level + 1, w.tree, leaf_p, w.p // 8, sha256(before || h || after), proof || before || after
        FROM walk w JOIN beside b ON b.level = w.level AND b.tree = w.tree AND b.p = w.p),
    arrived AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tree, leaf_p ORDER BY level DESC) = 1),
    climb(level, tree, leaf_p, p, h, proof) AS (
        SELECT 0, a.tree, leaf_p, over.p, h, proof FROM arrived a JOIN over ON over.tree = a.tree
        UNION ALL
        SELECT c.level + 1, tree, leaf_p, c.p // 8, sha256(before || h || after), proof || before || after
        FROM climb c JOIN above b ON b.level = c.level AND b.p = c.p),
    done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY tree, leaf_p ORDER BY level DESC) = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root AS verified
    FROM leaves JOIN done ON done.tree = leaves.tree AND done.leaf_p = leaves.p JOIN over ON over.tree = leaves.tree,
         (SELECT h AS root FROM top WHERE n = 1) r"""
