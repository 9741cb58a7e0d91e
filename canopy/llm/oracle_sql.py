"""DuckDB SQL of the queries that SQL can express on whole tables.

Written for itself: no module of the subpackage is imported. op1 (XXH64), op2 (a ring of XXH64), op3 (scores to the last
bit), op7 (trees), op8 (a page's tree), op9 and op10 (tokenizers) have none and are tested against brute-force versions.
"""

from __future__ import annotations

OP4 = """
WITH RECURSIVE whole AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
root AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT COUNT(*) FROM near n WHERE n.a = e.vec_id) AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON root.a = e.vec_id"""

OP6 = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
best AS (SELECT payload_digest, MAX(page_id) AS page FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest),
told AS (SELECT p.*, CASE WHEN best.page IS NOT NULL AND p.page_id IS DISTINCT FROM best.page THEN best.page END AS refers_to
         FROM p LEFT JOIN best ON p.payload_bytes >= 1000 AND best.payload_digest = p.payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM told"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _op5() -> str:
    # The contract's kinds in order, their expressions, the group whose length counts and its least length.
    words = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
    kinds = [("assign", f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16),
             ("hex", "[0-9a-f]+", 0, 32), ("random", "[A-Za-z0-9+/_-]+={0,2}", 0, 24)]
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # encodings in order: what the run is made of, what it must hold, its alphabet
    encodings = [("[0-9a-f]+", ("[0-9]", "[a-f]"), digits + "abcdef"), ("[0-9A-F]+", ("[0-9]", "[A-F]"), digits + "ABCDEF"),
                 ("[A-Z2-7]+", ("[2-7]", "[A-Z]"), upper + "234567"), ("[0-9a-z]+", ("[0-9]", "[a-z]"), digits + lower),
                 ("[0-9A-Z]+", ("[0-9]", "[A-Z]"), digits + upper), ("[0-9A-Za-z]+", ("[0-9]", "[A-Z]", "[a-z]"), digits + upper + lower),
                 ("[0-9A-Za-z+/]+", ("[0-9]", "[A-Z]", "[a-z]"), upper + lower + digits + "+/"),
                 ("[0-9A-Za-z_-]+", ("[0-9]", "[A-Z]", "[a-z]"), upper + lower + digits + "-_")]
    found = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        found.append(f"""cut_{name} AS (
  SELECT rid, UNNEST(string_split_regex(t, '{pattern}')) AS gap, UNNEST(list_append(regexp_extract_all(t, '{pattern}', 0), '')) AS hit,
         UNNEST(list_append(regexp_extract_all(t, '{pattern}', {group}), '')) AS val,
         UNNEST(range(len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i
  FROM d WHERE regexp_matches(t, '{pattern}')),
found_{name} AS (
  SELECT rid, {k} AS kind, e - length(hit) AS s, e, hit FROM (
    SELECT *, SUM(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS e FROM cut_{name})
  WHERE length(val) >= {least})""")
    which = " ".join(f"WHEN regexp_full_match(body, '{a}') AND {' AND '.join(f"regexp_matches(body, '{h}')" for h in held)} THEN {i}"
                     for i, (a, held, _x) in enumerate(encodings))
    alphabets = "[" + ", ".join(f"'{x}'" for _a, _h, x in encodings) + "]"

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.2316419 * abs({z})))"
        return (f"least(1.0, 2 * exp(-abs({z}) * abs({z}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * "
                f"(1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
{",".join(found)},
base AS (SELECT rid, kind, s, e FROM found_assign UNION ALL SELECT rid, kind, s, e FROM found_access UNION ALL SELECT rid, kind, s, e FROM found_hex),
runs AS (
  SELECT rid, s, e, body, CASE {which} END AS enc FROM (SELECT *, rtrim(hit, '=') AS body FROM found_random) r
  WHERE length(body) >= 24 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e)),
letters AS (
  SELECT rid, s, e, enc, length({alphabets}[enc + 1]) AS a, length(body) AS n, UNNEST(range(length(body))) AS i,
         strpos({alphabets}[enc + 1], body[CAST(UNNEST(range(1, length(body) + 1)) AS INTEGER)]) - 1 AS x
  FROM runs WHERE enc IS NOT NULL),
squares AS (SELECT rid, s, SUM(c * c) AS sq FROM (SELECT rid, s, x, COUNT(*) AS c FROM letters GROUP BY rid, s, x) GROUP BY rid, s),
pairs AS (SELECT *, LAG(x) OVER (PARTITION BY rid, s ORDER BY i) AS y FROM letters),
sums AS (
  SELECT rid, s, e, enc, a, n, SUM(CASE WHEN (x >= a / 2.0) <> (y >= a / 2.0) THEN 1 ELSE 0 END) AS changes,
         SUM((x - (a - 1) / 2.0) * (y - (a - 1) / 2.0)) AS crossed FROM pairs GROUP BY rid, s, e, enc, a, n),
z AS (
  SELECT m.*, (sq * a::DOUBLE / n - n - (a - 1)) / sqrt(2.0 * (a - 1) * (n - 1) / n) AS z1,
         (changes - (n - 1) / 2.0) / sqrt((n - 1) / 4.0) AS z2, crossed / ((a * a - 1) / 12.0) / sqrt(n - 1) AS z3
  FROM sums m JOIN squares USING (rid, s)),
tested AS (
  SELECT rid, s, e, enc * 64 + CAST(floor(log2(n)) AS INTEGER) AS class,
         least(600, CAST(floor(-log10(greatest(least(1.0, 3 * least({tail("z1")}, {tail("z2")}, {tail("z3")})), 1e-30)) * 20) AS INTEGER)) AS step FROM z),
steps AS (SELECT class, step, COUNT(*) AS c FROM tested GROUP BY class, step),
ranks AS (SELECT class, step, SUM(c) OVER (PARTITION BY class ORDER BY step DESC) AS rank, SUM(c) OVER (PARTITION BY class) AS m FROM steps),
cleared AS (SELECT class, MIN(step) AS least FROM ranks WHERE power(10.0, -step / 20.0) <= 0.05 * rank / m GROUP BY class),
spans AS (
  SELECT rid, kind, s, e FROM base
  UNION ALL SELECT rid, 3, s, e FROM tested LEFT JOIN cleared USING (class) WHERE step < COALESCE(least, 601)),
told AS (
  SELECT rid, COUNT(*) FILTER (kind = 0) AS n0, COUNT(*) FILTER (kind = 1) AS n1, COUNT(*) FILTER (kind = 2) AS n2,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS b,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS a
  FROM (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] AS name FROM spans) GROUP BY rid)
SELECT doc_id, COALESCE(n0, 0) AS n_assign, COALESCE(n1, 0) AS n_access, COALESCE(n2, 0) AS n_hex,
       sha256(COALESCE(b, '')) AS base_sha256, COALESCE(a, '') AS spans FROM d LEFT JOIN told USING (rid)"""


def _op11() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {words} AS words FROM benchmark),
total AS (SELECT COUNT(*) FILTER (len(words) > 0) AS n_docs, SUM(len(words)) AS n_terms FROM d),
tf AS (SELECT rid, term, COUNT(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w
           FROM tf, total GROUP BY term),
size AS (SELECT rid, doc_id, 25 + (75 * len(words) * n_docs) // CAST(n_terms AS BIGINT) AS m FROM d, total WHERE len(words) > 0),
wanted AS (SELECT iid, term, COUNT(*) AS repeats FROM (SELECT iid, unnest(words) AS term FROM i) GROUP BY iid, term),
scored AS (SELECT iid, rid, doc_id, CAST(SUM(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (rid) GROUP BY iid, rid, doc_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed JOIN i USING (iid) WHERE rank <= 10"""


_WHOLE = """
whole AS (SELECT row_number() OVER () AS rid, *, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP12 = f"""
WITH {_WHOLE},
named AS (SELECT rid, vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label FROM whole WHERE label IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
           FROM named a JOIN named b ON a.vec_id IS DISTINCT FROM b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positive AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same),
pair AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.place, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
         FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
         WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pair WHERE rank <= 5"""

OP13 = f"""
WITH {_WHOLE},
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
           FROM whole a JOIN whole b ON a.vec_id IS DISTINCT FROM b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5"""


ORACLE: dict[str, str] = {"op4_embedding_dedup": OP4, "op5_secret_scan": _op5(), "op6_warc": OP6, "op11_lexical_search": _op11(),
                          "op12_hard_negatives": OP12, "op13_exact_search": OP13}
