"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACE_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"

_TEMPLATES = ", ".join(f"('{label}', string_split('{words}', ' '))" for label, words in sorted(TEMPLATES.items()))

# the table-free CRC-32 of an ASCII key
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(key, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [x::BIGINT FOR x IN range(8)]), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))))"""
# states of a repaired conversation: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
_NEEDED = "(CASE q WHEN 2 THEN 3 ELSE 2 END)"
_KEPT = """(CASE WHEN q = 0 AND ini = 's' THEN 1 WHEN q = 0 AND ini = 'u' THEN 2 WHEN q = 1 AND ini = 'u' THEN 2
  WHEN q = 2 AND ini = 'a' THEN 3 WHEN q = 3 AND ini = 'u' THEN 2 END)"""


def _own(q: int) -> str:
    """Least cost of a row's own edits in state q, from the costs v behind the row."""
    keep = {0: "WHEN 's' THEN v[2] WHEN 'u' THEN v[3]", 1: "WHEN 'u' THEN v[3]", 2: "WHEN 'a' THEN v[4]", 3: "WHEN 'u' THEN v[3]"}[q]
    late = "(fault = 'truncated')::INT"
    return (f"least(3 + v[{q + 1}], CASE WHEN fault IN ('fine', 'truncated') THEN least({late} + coalesce(CASE ini {keep} END, 1000000000000), "
            f"2 + {late} + v[{4 if q == 2 else 3}]) ELSE 1000000000000 END)")


SQL: dict[str, str] = {
    "op2_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {SPACE_WORDS} AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, list_slice(w, p + 1, p + 4) AS g
          FROM w, LATERAL (SELECT unnest(range(0, greatest(len(w) - 3, 1))) AS p) WHERE len(w) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
        m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
    """,
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {ALNUM_WORDS} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark),
        iw AS (
          SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, p + 1, p + least(10, len(w))) AS g
          FROM i, LATERAL (SELECT unnest(range(0, greatest(len(w) - 9, 1))) AS p) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (
          SELECT r, n, p, list_slice(w, p + 1, p + n) AS g
          FROM d, sizes, LATERAL (SELECT unnest(range(0, len(w) - n + 1)) AS p) WHERE len(w) >= n
        ), h AS (SELECT r, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
        hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """,
    "op7_license_scan": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {ALNUM_WORDS} AS w, {LOWERED} AS t FROM documents),
        phrases AS (SELECT unnest([
          {{'g': ['gnu', 'general', 'public', 'license'], 'label': 'gpl'}}, {{'g': ['apache', 'license'], 'label': 'apache'}},
          {{'g': ['cc', 'by'], 'label': 'cc-by'}}, {{'g': ['mit', 'license'], 'label': 'mit'}}]) AS x),
        places AS (
          SELECT r, p, x.label AS label FROM d, phrases, LATERAL (SELECT unnest(range(0, len(w))) AS p)
          WHERE w[p + 1] = x.g[1] AND list_slice(w, p + 1, p + len(x.g)) = x.g
        ), base AS (
          SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r
        ), t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(label, g)),
        lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
        held AS (SELECT r, regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lines),
        share AS (
          SELECT r, label, len(list_intersect(list_distinct(w), list_distinct(g))) / len(list_distinct(g))::DOUBLE AS share FROM held, t WHERE len(w) > 0
        ), met AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM share WHERE share >= 0.8 GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, met.labels))), ','), '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN base USING (r) LEFT JOIN met USING (r)
    """,
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op11_fill_in_middle": """
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents
        ), k AS (
          SELECT *, len(u) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d
        ), c AS (
          SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                      WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k
        ), p AS (
          SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y,
                 coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                      ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS place FROM pages),
        g AS (
          SELECT *, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, place) AS k,
                 max(page_id) OVER (PARTITION BY html) AS top FROM p
        )
        SELECT page_id, octet_length(encode(html)) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
        FROM g
    """,
    "op13_conversation_repair": f"""
        WITH RECURSIVE raw AS (
          SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
        ), kinds AS (SELECT *, {_CRC} % 20 AS k FROM raw),
        dm AS (
          SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                 CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
                 unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
        ), od AS (
          SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
                 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dm
        ), ft AS (
          SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) IN ('.', '!', '?') THEN 'fine' ELSE 'truncated' END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM od
        ), st AS (
          SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM ft GROUP BY c
        ), ids AS (SELECT DISTINCT c, conv_id FROM raw),
        al AS (SELECT ids.c, conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
                      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal FROM ids LEFT JOIN st ON st.c = ids.c),
        bw AS (
          SELECT c, n AS i, [0, 4, 2, 0]::BIGINT[] AS v FROM al
          UNION ALL
          SELECT c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])]::BIGINT[]
          FROM (SELECT bw.c, bw.i - 1 AS i, [{_own(0)}, {_own(1)}, {_own(2)}, {_own(3)}]::BIGINT[] AS w FROM bw JOIN ft ON ft.c = bw.c AND ft.i = bw.i)
        ), fw AS (
          SELECT c, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM al
          UNION ALL
          SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN {_KEPT} ELSE {_NEEDED} END, audit || e,
                 CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                   ELSE list_append(lines, (CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END) || CASE WHEN e = 'R' THEN text ELSE '' END) END
          FROM (
            SELECT fw.c, fw.i, q, audit, lines, role, text, ini, CASE
              WHEN fault IS NOT NULL AND 3 + b.v[q + 1] = a.v[q + 1] THEN 'D'
              WHEN 2 + a.v[{_NEEDED} + 1] = a.v[q + 1] THEN 'I'
              WHEN fault IN ('fine', 'truncated') AND (fault = 'truncated')::INT + b.v[{_KEPT} + 1] = a.v[q + 1] THEN 'K'
              WHEN fault IN ('fine', 'truncated') THEN 'R' END AS e
            FROM fw JOIN al ON al.c = fw.c JOIN bw a ON a.c = fw.c AND a.i = fw.i LEFT JOIN bw b ON b.c = fw.c AND b.i = fw.i + 1
            LEFT JOIN ft ON ft.c = fw.c AND ft.i = fw.i + 1 WHERE fw.i < n OR q IN (1, 2)
          )
        )
        SELECT conv_id, gaps, blank, duplicate, truncated, illegal, bw.v[1] AS cost, audit,
               sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM al JOIN bw ON bw.c = al.c AND bw.i = 0 JOIN fw ON fw.c = al.c AND fw.i = n AND fw.q IN (0, 3)
    """,
}
