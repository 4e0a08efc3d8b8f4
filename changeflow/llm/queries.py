"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from changeflow.llm import (
    collocations,
    decontam,
    htmltext,
    langid,
    licences,
    merkle,
    neighbours,
    oracles,
    packing,
    secrets,
    simhash,
    syncmers,
    tokencount,
    tokenfile,
)

QUERIES = {
    "op1_html": htmltext.op1_html,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_token_files": tokenfile.op5_token_files,
    "op6_licences": licences.op6_licences,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_langid": langid.op10_langid,
    "op11_syncmers": syncmers.op11_syncmers,
    "op12_collocations": collocations.op12_collocations,
    "op13_manifest": merkle.op13_manifest,
}


def _licence_sql() -> str:
    """The licence scan in SQL, over the same phrases and notices."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"('{label}', {quoted(phrase.split())})" for label, phrase in licences.BASE.items())
    notices = []
    for k, (label, phrase, notice) in enumerate(licences.NOTICES):
        cut, whole = phrase.split(), notice.split()
        inside = next(i for i in range(len(whole)) if whole[i : i + len(cut)] == cut)
        notices.append(f"({k}, '{label}', {quoted(cut)}, {quoted(whole)}, {inside})")
    return f"""
        WITH base(label, p) AS (VALUES {base}),
        notice(k, label, p, t, inside) AS (VALUES {", ".join(notices)}),
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        word AS (SELECT DISTINCT unnest(t) AS word FROM notice),
        idf AS (
            SELECT word, ln(1 + (SELECT count(*) FROM d) / (1 + sum(CASE WHEN list_contains(w, word) THEN 1 ELSE 0 END))) AS idf
            FROM word CROSS JOIN d GROUP BY word),
        place AS (
            SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS start
            FROM d CROSS JOIN base WHERE list_has_all(w, p)),
        found AS (
            SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
        laid AS (
            SELECT doc_id, k, label, t, w, inside,
                   unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS start
            FROM d CROSS JOIN notice WHERE list_has_all(w, p)),
        step AS (SELECT *, unnest(range(1, len(t) + 1)) AS j FROM laid),
        share AS (
            SELECT doc_id, k, label, start,
                   round(sum(CASE WHEN start - inside + j >= 1 AND w[start - inside + j] = word THEN idf ELSE 0 END) / sum(idf), 9) AS share
            FROM step JOIN idf ON word = t[j] GROUP BY doc_id, k, label, start),
        score AS (SELECT doc_id, max(share) AS score FROM share GROUP BY doc_id),
        named AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
                SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM share WHERE share >= {licences.SHARE}) x
            GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN score USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op6_licences": _licence_sql(),
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_manifest": oracles.MANIFEST,
}
