"""DuckDB SQL for the text queries that SQL can express; every one works on the whole table."""

from __future__ import annotations

from .divergence import LEAST_DOCS as TERM_DOCS
from .divergence import SCALE, TOP_TERMS
from .imatch import LEAST_DOCS, LEAST_SHARE, LEAST_TERMS, MARKS, MOST_SHARE, SUBSETS
from .jaccard import THRESHOLD
from .suffix_dedup import LENGTH
from .warc import LEAST_BYTES


def _imatch() -> str:
    marks = MARKS.replace("'", "''")
    words = lambda t: f"list_distinct(list_filter(string_split_regex(translate(lower({t}), '{marks}', ''), '[ \\t-\\r]+'), lambda w: w <> ''))"
    # The k-th lexicon keeps one term in 2 ** (k + 1): 8000, 4000, 2000, ... in hexadecimal digits.
    has = lambda k: f"FILTER (substr(md5(term), {4 * k + 1}, 4) < printf('%04x', 32768 >> {k}))"
    chosen = ", ".join(f"string_agg(term, ' ' ORDER BY term) {has(k)} AS p{k}, count(*) {has(k)} AS n{k}" for k in range(SUBSETS))
    part = lambda k: f"substr(sha1(CASE WHEN n{k} >= {LEAST_TERMS} THEN 't' || p{k} ELSE 'w' || whole END), 1, 16)"
    likeness = lambda a, b: " + ".join(f"(CASE WHEN split_part({a}, '-', {k + 1}) = split_part({b}, '-', {k + 1}) THEN 1 ELSE 0 END)" for k in range(SUBSETS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), total AS (SELECT count(*) AS n FROM d),
 o AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS after_id FROM d WINDOW w AS (ORDER BY doc_id DESC)),
 e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(after_text, 1, n_chars // 2) AS edited FROM o),
 both_texts AS (SELECT doc_id, 1 AS of, sha1(text) AS whole, {words('text')} AS terms FROM e UNION ALL SELECT doc_id, 2, sha1(edited), {words('edited')} FROM e),
 lexicon AS (SELECT term FROM (SELECT unnest(terms) AS term FROM both_texts WHERE of = 1), total GROUP BY term, n HAVING count(*) >= greatest({LEAST_DOCS}, {LEAST_SHARE}::DOUBLE * n) AND count(*) <= greatest({LEAST_DOCS}, {MOST_SHARE}::DOUBLE * n)),
 kept AS (SELECT doc_id, of, {chosen} FROM (SELECT doc_id, of, unnest(terms) AS term FROM both_texts) SEMI JOIN lexicon USING (term) GROUP BY ALL),
 prints AS (SELECT doc_id, of, concat_ws('-', {', '.join(part(k) for k in range(SUBSETS))}) AS f FROM both_texts LEFT JOIN kept USING (doc_id, of))
 SELECT e.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, ({likeness('a.f', 'b.f')}) / {SUBSETS}::DOUBLE AS near_edited, ({likeness('a.f', 'c.f')}) / {SUBSETS}::DOUBLE AS near_next
 FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.of = 1 JOIN prints b ON b.doc_id = e.doc_id AND b.of = 2 JOIN prints c ON c.doc_id = e.after_id AND c.of = 1"""


def _repeats() -> str:
    n = LENGTH
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 l AS (SELECT doc_id, h, range(0, length(h) // 2 - {n - 1}) AS starts FROM d), w AS (SELECT doc_id, unnest(starts) AS p, unnest(list_transform(starts, lambda p: md5(substr(h, 2 * p + 1, {2 * n})))) AS s FROM l),
 m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s), c AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > least),
 marked AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {n} THEN 0 ELSE 1 END AS opens FROM c),
 numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
 runs AS (SELECT doc_id, run, min(p) AS a, max(p) + {n} AS b FROM numbered GROUP BY ALL),
 gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (coalesce(high, length(h) // 2) - low)), '' ORDER BY low) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
 sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""


def _groups() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= {THRESHOLD:e} * (a.n + b.n - c) - 1e-6),
 reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
 SELECT reach.doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE x = reach.doc_id) AS n_links FROM reach GROUP BY reach.doc_id"""


def _manifest(levels: int = 20) -> str:
    """Trees of up to 3 ** levels leaves, level by level."""
    item = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(item(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {item(text)})"
    bits = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::BIGINT)), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    out = [f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS spoilt FROM documents)"]
    out.append("a0 AS (SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)")
    grow = lambda of, k: f"{of}{k + 1} AS (SELECT tree, i // 3 AS i, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {of}{k} WHERE n > 1 GROUP BY tree, i // 3, n)"
    tops = lambda of: " UNION ALL ".join(f"SELECT tree, h FROM {of}{k} WHERE n = 1" for k in range(levels + 1))
    # What stands beside a node: the others of its run, left and right.
    beside = lambda of, k: f"(SELECT p.tree, p.i, coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i < p.i), '') AS l, coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i > p.i), '') AS r FROM {of}{k} p JOIN {of}{k} q ON q.tree = p.tree AND q.i // 3 = p.i // 3 WHERE p.n > 1 GROUP BY p.tree, p.i)"
    out.append("s0 AS (SELECT tree, i, n, leaf AS h FROM a0)")
    out += [grow("s", k) for k in range(levels)]
    out.append(f"sub AS ({tops('s')}), t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, h FROM sub)")
    out += [grow("t", k) for k in range(levels)]
    out.append(f"top AS (SELECT h AS root FROM ({tops('t')})), f0 AS (SELECT a0.*, sub.h AS subroot, root, t0.i AS ti, '' AS proof, coalesce(spoilt, leaf) AS folded FROM a0 JOIN sub USING (tree) JOIN t0 ON t0.h = sub.h AND t0.i = (SELECT count(*) FROM sub s WHERE encode(s.tree) < encode(a0.tree)), top)")
    fold = lambda x, y, of, k, tree, i: f"{y} AS (SELECT f.* EXCLUDE (proof, folded), proof || coalesce(l || r, '') AS proof, CASE WHEN l IS NULL THEN folded ELSE sha256(l || folded || r) END AS folded FROM {x} f LEFT JOIN {beside(of, k)} b ON b.tree = {tree} AND b.i = f.{i} // {3**k})"
    out += [fold(f"f{k}", f"f{k + 1}", "s", k, "f.tree", "i") for k in range(levels)]
    out += [fold(f"f{levels + k}", f"f{levels + k + 1}", "t", k, "''", "ti") for k in range(levels)]
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{2 * levels}"


def _divergence() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda c, n: f"(1 + {SCALE}::HUGEINT * ({c} + 2) // nullif({n} + 2 * v, 0))::BIGINT"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {TERM_DOCS}), langs AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT lang, source, coalesce((SELECT sum(c) FROM c WHERE c.lang = e.lang AND c.source = e.source), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) e),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {share('coalesce(c.c, 0)', 'g.n')} AS p, {share('k.c', 'langs.n')} AS q FROM g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q)
 SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""


def _archive() -> str:
    return f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, url, true AS intact FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_imatch_fingerprints": _imatch(), "op6_suffix_array_dedup": _repeats(), "op8_ngram_jaccard_join": _groups(),
        "op11_merkle_manifest": _manifest(), "op12_source_divergence": _divergence(), "op13_warc_archive": _archive(),
    }
