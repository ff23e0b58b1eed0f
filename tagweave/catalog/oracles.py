"""The same queries as plain SQL over the given tables, for an independent engine to check."""

from __future__ import annotations

import math

from tagweave.catalog import tables as t
from tagweave.functions import mathx
from tagweave.operators import stem

K, SEEDS, ATOMS = t.K, t.SEEDS, t.ATOMS
A, B, S = t.MODEL.a, t.MODEL.b, t.MODEL.smoothness


def num(v: float) -> str:
    """A literal that is read as a double."""
    return f"{v:.17e}"


def uniform(digest: str, word: int = 0) -> str:
    return f"((concat('0x', substr({digest}, {8 * word + 1}, 8))::BIGINT + 5e-1) / 4294967296e0)"


def normal_gamma(digest: str, word: int) -> str:
    z = f"(sqrt(-2e0 * ln({uniform(digest, word)})) * cos({num(2 * math.pi)} * {uniform(digest, word + 1)}))"
    return f"({num(S)} * pow(1e0 - {num(1 / (9 * S))} + {z} / {num(3 * math.sqrt(S))}, 3e0))"


def digamma(x: str) -> str:
    z = f"({x} + 8e0)"
    y = f"(1e0 / ({z} * {z}))"
    series = " + ".join(
        f"({num(c)}) * pow({y}, {n}e0)" for n, c in enumerate(mathx.DIGAMMA_SERIES, start=1)
    )
    back = " + ".join(f"1e0 / ({x} + {j}e0)" for j in range(8))
    return f"(ln({z}) - 5e-1 / {z} - ({series}) - ({back}))"


def with_all(steps: list[tuple[str, str]], final: str) -> str:
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)
    return f"WITH {ctes}\n{final}"


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0"


ORACLES: dict[str, str] = {}

# Sources, getters, ragged arrays

ORACLES["load_tracks"] = ORACLES["write_tracks"] = """
SELECT o_orderkey AS song_idx, c_name AS artist_name, n_name AS location, o_totalprice AS hotttnesss
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
ORACLES["count_songs"] = "SELECT count(*) AS n_songs FROM documents"
ORACLES["project_track_scalars"] = "SELECT doc_id AS song_idx, lang, source, n_chars FROM documents"
ORACLES["select_song_at"] = "SELECT doc_id AS song_idx, lang, source, n_chars FROM documents WHERE doc_id = 0"
ORACLES["ragged_slice"] = """
SELECT o_orderkey AS song_idx, count(l_orderkey)::INTEGER AS n,
       coalesce(string_agg(round(l_extendedprice * 100)::BIGINT::VARCHAR, ',' ORDER BY l_linenumber, l_extendedprice), '') AS cents
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
ORACLES["ragged_slice_2d"] = f"""
WITH weighted AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS j, sum(v::DOUBLE * p) AS w
  FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)
  GROUP BY label, vec_id)
SELECT label::BIGINT AS song_idx, count(*) AS n, {r6('sum(w * j)', 4)} AS digest FROM weighted GROUP BY label"""
ORACLES["ragged_chunks"] = f"""
WITH placed AS (
  SELECT label, embedding[1]::DOUBLE AS v, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS chunk FROM embeddings)
SELECT label::BIGINT AS song_idx, chunk, count(*)::INTEGER AS n, {r6('sum(v)', 4)} AS total FROM placed GROUP BY label, chunk"""
ORACLES["explode_segments"] = """
SELECT vec_id AS point_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS seg, unnest(embedding)::DOUBLE AS value
FROM embeddings"""
WORDS = "SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS raw FROM documents"
ORACLES["zip_terms"] = f"""
SELECT raw AS term, count(*) AS n, sum(length(raw))::BIGINT AS weight FROM ({WORDS}) GROUP BY raw"""

# Codebooks and vector quantization. Long vectors (id, dim, v) keep every step an aggregation.

POINTS = [
    (
        "p",
        "SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v "
        "FROM embeddings",
    )
]


def seeds_of(k: int, source: str = "embeddings", order: str = "vec_id") -> str:
    """The first k distinct vectors of a source with vec_id, embedding and an order."""
    return (
        f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS code, vec_id AS id, embedding FROM "
        f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY embedding ORDER BY {order}) = 1) "
        f"QUALIFY row_number() OVER (ORDER BY {order}) <= {k}"
    )


LONG_SEEDS = (
    "SELECT code, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v, code + 1e0 AS size "
    "FROM seeds"
)


def seed_steps(k: int) -> list[tuple[str, str]]:
    return [*POINTS, ("seeds", seeds_of(k)), ("book", LONG_SEEDS)]


def costs(points: str, book: str, balanced: bool = True) -> str:
    balance = "any_value(b.size) / (1e0 + any_value(b.size)) * " if balanced else ""
    return (
        f"SELECT p.id, b.code, {balance}sum((p.v - b.v) * (p.v - b.v)) AS cost "
        f"FROM {points} p JOIN {book} b USING (dim) GROUP BY p.id, b.code"
    )


def nearest(costs_sql: str) -> str:
    return f"SELECT id, code, cost FROM ({costs_sql}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, code) = 1"


def add_batch(name: str, points: str, book: str, balanced: bool = True) -> list[tuple[str, str]]:
    """Assign a batch with frozen centers and move the running means: makes the book ``name``."""
    return [
        (f"{name}_near", nearest(costs(points, book, balanced))),
        (
            f"{name}_sum",
            f"SELECT n.code, p.dim, sum(p.v) AS total, count(*) AS m "
            f"FROM {name}_near n JOIN {points} p USING (id) GROUP BY n.code, p.dim",
        ),
        (
            name,
            f"SELECT b.code, b.dim, coalesce((b.size * b.v + s.total) / (b.size + s.m), b.v) AS v, "
            f"b.size + coalesce(s.m, 0) AS size FROM {book} b LEFT JOIN {name}_sum s USING (code, dim)",
        ),
    ]


def seeded_batch(name: str, source: str, k: int, order: str, balanced: bool = True) -> list[tuple[str, str]]:
    """A first batch: its seeds count once, all its other points are added."""
    return [
        (f"{name}_seeds", seeds_of(k, source, order)),
        (
            f"{name}_start",
            f"SELECT code, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v, 1e0 AS size "
            f"FROM {name}_seeds",
        ),
        (
            f"{name}_rest",
            f"SELECT p.* FROM p WHERE id IN (SELECT vec_id FROM {source}) AND id NOT IN (SELECT id FROM {name}_seeds)",
        ),
        *add_batch(name, f"{name}_rest", f"{name}_start", balanced),
    ]


def book_rows(book: str) -> str:
    return f"SELECT code::INTEGER AS code, dim::INTEGER AS dim, {r6('v')} AS value, size::DOUBLE AS size FROM {book}"


def half_norms(book: str) -> str:
    return (
        f"SELECT code::INTEGER AS code, any_value(size)::DOUBLE AS size, {r6('5e-1 * sum(v * v)')} AS half_norm "
        f"FROM {book} GROUP BY code"
    )


def shuffled(label: str) -> tuple[str, str]:
    digest = f"md5('{label}:' || vec_id)"
    return (
        "shuffled_" + label.replace(":", "_"),
        f"SELECT vec_id, embedding, {digest} AS ord, floor({uniform(digest)} * 2) AS batch FROM embeddings",
    )


def half(label: str, n: int) -> str:
    return f"half_{label.replace(':', '_')}_{n}"


def halves(label: str) -> list[tuple[str, str]]:
    name, sql = shuffled(label)
    return [
        (name, sql),
        *[(half(label, n), f"SELECT vec_id, embedding, ord FROM {name} WHERE batch = {n}") for n in range(2)],
    ]


def long_half(label: str, n: int) -> tuple[str, str]:
    return f"long_{half(label, n)}", f"SELECT p.* FROM p WHERE id IN (SELECT vec_id FROM {half(label, n)})"


ORACLES["codebook_seed"] = with_all(
    [("seeds", seeds_of(SEEDS))],
    f"SELECT code::INTEGER AS code, id AS point_id, {r6('embedding[1]::DOUBLE')} AS first_value FROM seeds",
)
ORACLES["hartigan_assign"] = with_all(
    [*seed_steps(SEEDS), ("near", nearest(costs("p", "book")))],
    f"SELECT id AS point_id, code::INTEGER AS code, {r6('cost')} AS cost FROM near",
)
ORACLES["hartigan_partial_fit"] = with_all(
    [*POINTS, *seeded_batch("b1", "embeddings", SEEDS, "vec_id")], book_rows("b1")
)


def first_pass(balanced: bool = True) -> list[tuple[str, str]]:
    return [
        *POINTS,
        *halves("0:0"),
        *seeded_batch("b1", half("0:0", 0), SEEDS, "ord, vec_id", balanced),
        long_half("0:0", 1),
        *add_batch("b2", long_half("0:0", 1)[0], "b1", balanced),
    ]


def two_passes(balanced: bool) -> list[tuple[str, str]]:
    return [
        *first_pass(balanced),
        *halves("0:1"),
        long_half("0:1", 0),
        *add_batch("b3", long_half("0:1", 0)[0], "b2", balanced),
        long_half("0:1", 1),
        *add_batch("b4", long_half("0:1", 1)[0], "b3", balanced),
    ]


TWO_HALVES = first_pass()
ORACLES["hartigan_fit"] = with_all(two_passes(True), book_rows("b4"))
ORACLES["minibatch_kmeans"] = with_all(two_passes(False), book_rows("b4"))
ORACLES["hartigan_sharded"] = with_all([*POINTS, *seeded_batch("b1", "embeddings", ATOMS, "vec_id")], book_rows("b1"))


def squares(points: str, book: str, key: str) -> str:
    """Squared distances ``id, key, cost`` of points (id, dim, v) to centers (key, dim, v)."""
    return f"SELECT p.id, b.{key}, sum((p.v - b.v) * (p.v - b.v)) AS cost FROM {points} p JOIN {book} b USING (dim) GROUP BY p.id, b.{key}"


def closest(points: str, book: str, key: str) -> str:
    return f"SELECT id, {key}, cost FROM ({squares(points, book, key)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, {key}) = 1"


def long_vectors(source: str, number: str) -> str:
    return f"SELECT {number}, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM {source}"


def kmeans(k: int, rounds: int, refine: int, max_iter: int, oversample: float = 2.0) -> list[tuple[str, str]]:
    """k-means|| seeding with its rounds unrolled, weighted reclustering, and rounds over all points."""
    steps = [
        *POINTS,
        ("first", "SELECT embedding FROM embeddings ORDER BY md5('0:first:' || vec_id), embedding LIMIT 1"),
        ("cand_0", long_vectors("first", "0 AS cid")),
    ]
    for n in range(rounds):
        steps += [
            (f"near_{n}", closest("p", f"cand_{n}", "cid")),
            (
                f"drawn_{n}",
                f"SELECT DISTINCT embedding FROM embeddings JOIN near_{n} ON id = vec_id WHERE {uniform(f"md5('0:{n}:' || vec_id)")} "
                f"< least(1e0, {num(oversample * k)} / (SELECT sum(cost) FROM near_{n}) * cost)",
            ),
            (
                f"more_{n}",
                f"SELECT (SELECT max(cid) FROM cand_{n}) + row_number() OVER (ORDER BY embedding) AS cid, embedding FROM drawn_{n}",
            ),
            (f"cand_{n + 1}", f"SELECT * FROM cand_{n} UNION ALL {long_vectors(f'more_{n}', 'cid')}"),
        ]
    cand = f"cand_{rounds}"
    steps += [
        ("weighed", f"SELECT cid, count(*)::DOUBLE AS n FROM ({closest('p', cand, 'cid')}) GROUP BY cid"),
        ("apart", f"SELECT a.cid AS a, b.cid AS b, sum((a.v - b.v) * (a.v - b.v)) AS d FROM {cand} a JOIN {cand} b USING (dim) GROUP BY a.cid, b.cid"),
        ("pick_0", "SELECT cid FROM weighed ORDER BY n DESC, cid LIMIT 1"),
        ("least_0", "SELECT a AS cid, d FROM apart WHERE b = (SELECT cid FROM pick_0)"),
    ]
    for j in range(1, k):
        steps += [
            (f"pick_{j}", f"SELECT cid FROM weighed JOIN least_{j - 1} USING (cid) ORDER BY n * d DESC, cid LIMIT 1"),
            (f"least_{j}", f"SELECT l.cid, least(l.d, x.d) AS d FROM least_{j - 1} l JOIN apart x ON x.a = l.cid AND x.b = (SELECT cid FROM pick_{j})"),
        ]
    picked = " UNION ALL ".join(f"SELECT {j} AS code, cid FROM pick_{j}" for j in range(k))
    steps.append(("center_0", f"SELECT code, dim, v FROM ({picked}) JOIN {cand} USING (cid)"))
    steps.append(("spots", f"SELECT cid AS id, dim, v FROM {cand}"))
    for n in range(refine):
        steps += [
            (f"spot_{n}", closest("spots", f"center_{n}", "code")),
            (
                f"mean_{n}",
                f"SELECT s.code, x.dim, sum(x.v * w.n) / sum(w.n) AS v FROM spot_{n} s JOIN weighed w ON w.cid = s.id JOIN spots x ON x.id = s.id "
                "GROUP BY s.code, x.dim",
            ),
            (f"center_{n + 1}", f"SELECT c.code, c.dim, coalesce(m.v, c.v) AS v FROM center_{n} c LEFT JOIN mean_{n} m USING (code, dim)"),
        ]
    steps.append(("book_0", f"SELECT *, 0e0 AS size FROM center_{refine}"))
    for n in range(max_iter):
        steps += [
            (f"own_{n}", closest("p", f"book_{n}", "code")),
            (f"sum_{n}", f"SELECT o.code, p.dim, avg(p.v) AS v, count(*)::DOUBLE AS size FROM own_{n} o JOIN p USING (id) GROUP BY o.code, p.dim"),
            (
                f"book_{n + 1}",
                f"SELECT b.code, b.dim, coalesce(s.v, b.v) AS v, coalesce(s.size, 0) AS size FROM book_{n} b LEFT JOIN sum_{n} s USING (code, dim)",
            ),
        ]
    return steps


ORACLES["kmeans_codebook"] = with_all(kmeans(SEEDS, 2, 2, 3), book_rows("book_3"))
IN_ORDER = [
    (
        f"low_{n}",
        f"SELECT vec_id, embedding, vec_id AS ord FROM embeddings QUALIFY "
        f"(row_number() OVER (ORDER BY vec_id) - 1) // ceil((SELECT count(*) FROM embeddings) / 2e0)::BIGINT = {n}",
    )
    for n in range(2)
]
LOW = [(f"long_low_{n}", f"SELECT p.* FROM p WHERE id IN (SELECT vec_id FROM low_{n})") for n in range(2)]
ORACLES["hartigan_fit_in_order"] = with_all(
    [
        *POINTS,
        *IN_ORDER,
        *LOW,
        *seeded_batch("b1", "low_0", SEEDS, "vec_id"),
        *add_batch("b2", "long_low_1", "b1"),
        *add_batch("b3", "long_low_0", "b2"),
        *add_batch("b4", "long_low_1", "b3"),
    ],
    book_rows("b4"),
)
ORACLES["hartigan_repeated_ids"] = f"SELECT count(*)::DOUBLE AS n_points, {SEEDS}::BIGINT AS n_codes FROM embeddings"
ORACLES["vq_fit_default"] = with_all(
    [*POINTS, *seeded_batch("b1", "embeddings", ATOMS, "vec_id", False)], half_norms("b1")
)
ORACLES["vq_fit"] = with_all([*POINTS, *seeded_batch("b1", "embeddings", ATOMS, "vec_id")], half_norms("b1"))
ORACLES["vq_partial_fit"] = with_all(TWO_HALVES, half_norms("b2"))

CODED = [
    *seed_steps(ATOMS),
    (
        "scored",
        "SELECT p.id, any_value(p.label) AS label, b.code, 5e-1 * sum(b.v * b.v) - sum(p.v * b.v) AS score "
        "FROM p JOIN book b USING (dim) GROUP BY p.id, b.code",
    ),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, code) AS rank FROM scored"),
]
ORACLES["vq_encode_hard"] = with_all(
    CODED, "SELECT id AS point_id, code::INTEGER AS code FROM ranked WHERE rank = 1"
)
ORACLES["vq_encode_soft"] = with_all(
    CODED, "SELECT id AS point_id, rank::INTEGER AS rank, code::INTEGER AS code FROM ranked WHERE rank <= 3"
)
ORACLES["vq_indicator_sparse"] = with_all(
    CODED, "SELECT id AS point_id, code::INTEGER AS code FROM ranked WHERE rank <= 2"
)
ORACLES["vq_indicator_dense"] = with_all(
    CODED,
    "SELECT id AS point_id, string_agg(CASE WHEN rank <= 2 THEN '1' ELSE '0' END, '' ORDER BY code) AS bits "
    "FROM ranked GROUP BY id",
)
ORACLES["vq_histogram"] = ORACLES["write_codes"] = with_all(
    CODED, "SELECT label AS track, code::INTEGER AS code, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL"
)
ORACLES["scan_saved"] = with_all(
    CODED, "SELECT code::INTEGER AS code, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL"
)

# Tags. Each stemming step is one SELECT over the words of the one before.


def cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def matches(word: str, shape: str) -> str:
    return f"regexp_matches({word}, '{shape}')"


def cases(branches: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " ELSE w END"


def replacing(rules: list[tuple[str, str]]) -> str:
    branches = [("length(w) <= 2", "w")]
    for suffix, new in rules:
        shape = matches(cut(len(suffix)), stem.MEASURE_ABOVE_0)
        branches.append(
            (f"ends_with(w, '{suffix}')", f"CASE WHEN {shape} THEN {cut(len(suffix))} || '{new}' ELSE w END")
        )
    return cases(branches)


def stem_steps(source: str) -> list[tuple[str, str]]:
    """Steps from a table of distinct words ``(w0, w)`` to ``stemmed(w0, w)``."""
    plural = cases(
        [("length(w) <= 2", "w"), ("length(w) = 4 AND ends_with(w, 'ies')", cut(1))]
        + [(f"ends_with(w, '{s}')", f"{cut(len(s))} || '{new}'") for s, new in stem.PLURALS]
    )
    past = cases(
        [
            ("length(w) <= 2", "w"),
            ("ends_with(w, 'eed')", f"CASE WHEN {matches(cut(3), stem.MEASURE_ABOVE_0)} THEN {cut(1)} ELSE w END"),
            ("length(w) = 4 AND ends_with(w, 'ied')", cut(1)),
            ("ends_with(w, 'ed')", f"CASE WHEN {matches(cut(2), stem.HAS_VOWEL)} THEN {cut(2)} || ' ' ELSE w END"),
            ("ends_with(w, 'ing')", f"CASE WHEN {matches(cut(3), stem.HAS_VOWEL)} THEN {cut(3)} || ' ' ELSE w END"),
        ]
    )
    bare = cut(1)
    repair = cases(
        [
            ("NOT ends_with(w, ' ')", "w"),
            (matches(bare, "(at|bl|iz)$"), f"{bare} || 'e'"),
            (matches(bare, stem.DOUBLED), cut(2)),
            (matches(bare, stem.SHORT), f"{bare} || 'e'"),
            ("true", bare),
        ]
    )
    final_y = cases([(f"length(w) > 2 AND {matches('w', stem.Y_AFTER_CONSONANT)}", f"{bare} || 'i'")])
    dropping = [("length(w) <= 2", "w")]
    for suffix in stem.STEP_4:
        kept = cut(3 if suffix in ("sion", "tion") else len(suffix))
        dropping.append(
            (f"ends_with(w, '{suffix}')", f"CASE WHEN {matches(kept, stem.MEASURE_ABOVE_1)} THEN {kept} ELSE w END")
        )
    loses = (
        f"({matches(bare, stem.MEASURE_ABOVE_1)} OR "
        f"({matches(bare, stem.MEASURE_ABOVE_0)} AND NOT {matches(bare, stem.SHORT)}))"
    )
    final_e = cases([(f"length(w) > 2 AND ends_with(w, 'e') AND {loses}", bare)])
    final_l = cases([(f"ends_with(w, 'll') AND {matches(bare, stem.MEASURE_ABOVE_1)}", bare)])
    chain = [plural, past, repair, final_y, replacing(stem.STEP_2), replacing(stem.STEP_3), cases(dropping), final_e]
    steps, before = [], source
    for n, expression in enumerate(chain):
        steps.append((f"stem{n}", f"SELECT w0, {expression} AS w FROM {before}"))
        before = f"stem{n}"
    own = (
        "CASE WHEN w0 IN ('sky', 'skies') THEN 'sky' WHEN w0 = 'dying' THEN 'die' WHEN w0 = 'lying' THEN 'lie' "
        "WHEN w0 = 'tying' THEN 'tie' WHEN w0 IN ('news', 'howe', 'proceed', 'exceed', 'succeed') THEN w0 "
        "WHEN w0 IN ('inning', 'innings') THEN 'inning' WHEN w0 IN ('outing', 'outings') THEN 'outing' "
        f"WHEN w0 IN ('canning', 'cannings') THEN 'canning' ELSE {final_l} END"
    )
    return [*steps, ("stemmed", f"SELECT w0, {own} AS w FROM {before}")]


TAGS = [
    ("words", f"SELECT doc_id AS track, raw FROM ({WORDS}) WHERE raw <> ''"),
    ("raws", "SELECT DISTINCT raw FROM words"),
    (
        "pieces",
        "SELECT raw, unnest(list) AS w0, generate_subscripts(list, 1) AS n FROM "
        "(SELECT raw, regexp_split_to_array(lower(raw), '[^\\p{L}\\p{N}]+') AS list FROM raws)",
    ),
    ("vocab0", "SELECT DISTINCT w0, w0 AS w FROM pieces WHERE w0 <> ''"),
    *stem_steps("vocab0"),
    (
        "normal",
        "SELECT raw, coalesce(string_agg(s.w, '' ORDER BY n), '') AS tag "
        "FROM pieces LEFT JOIN stemmed s USING (w0) GROUP BY raw",
    ),
]
TAG_COUNTS = [
    *TAGS,
    ("tags", "SELECT track, tag, count(*) AS n FROM words JOIN normal USING (raw) WHERE tag <> '' GROUP BY track, tag"),
    (
        "top",
        f"SELECT tag, count(DISTINCT track) AS n_tracks FROM tags GROUP BY tag "
        f"ORDER BY n_tracks DESC, tag LIMIT {t.VOCABULARY}",
    ),
    ("vocab", "SELECT (row_number() OVER (ORDER BY tag) - 1)::INTEGER AS tag_id, tag FROM top"),
]
ORACLES["normalize_tags"] = with_all(TAGS, "SELECT raw, tag FROM normal")
ORACLES["build_tag_vocab"] = with_all(TAG_COUNTS, "SELECT tag, n_tracks FROM top")
ORACLES["encode_tag_ids"] = with_all(TAG_COUNTS, "SELECT tag_id, tag FROM vocab")
BAGS = [*TAG_COUNTS, ("bags", "SELECT track, tag_id, sum(n)::BIGINT AS n FROM tags JOIN vocab USING (tag) GROUP BY ALL")]
ORACLES["bag_of_tags"] = ORACLES["write_bags"] = with_all(BAGS, "SELECT track, tag_id, n FROM bags")
for name, test in [("tags_in_vocab", "IN"), ("tags_out_of_vocab", "NOT IN")]:
    ORACLES[name] = with_all(
        TAG_COUNTS,
        f"SELECT track, count(*) AS n_tags, sum(n)::BIGINT AS n FROM tags "
        f"WHERE tag {test} (SELECT tag FROM vocab) GROUP BY track",
    )
ORACLES["joint_matrix"] = with_all(
    [*CODED, *BAGS],
    f"""SELECT id AS i, code::INTEGER AS d, 1e0 AS x FROM ranked WHERE rank <= 3
UNION ALL SELECT track, tag_id + {ATOMS}, n::DOUBLE FROM bags""",
)

# Counts and factorization. Factors are long rows (id, k, g, r, e, el).

COUNTS = [
    (
        "cells",
        "SELECT o_custkey AS i, p_brand || '|' || p_type AS label, count(*)::DOUBLE AS x "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    ),
    ("cols", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS d FROM (SELECT DISTINCT label FROM cells)"),
    ("x", "SELECT i, d, x FROM cells JOIN cols USING (label)"),
    ("rows", "SELECT DISTINCT c_custkey AS i FROM customer"),
    ("ks", f"SELECT unnest(range({K})) AS k"),
]
ORACLES["count_matrix"] = with_all(COUNTS, "SELECT i, label AS d, x FROM cells")


def expected(source: str) -> str:
    return f"SELECT *, g / r AS e, {digamma('g')} - ln(r) AS el FROM ({source})"


def drawn(role: str, ids: str, key: str) -> str:
    digest = f"SELECT {key}, k, md5('0:{role}:' || {key} || ':' || k) AS h FROM {ids}, ks"
    return expected(f"SELECT {key}, k, {normal_gamma('h', 0)} AS g, {normal_gamma('h', 2)} AS r FROM ({digest})")


def rates(theta: str, beta: str, x: str = "x") -> str:
    return (
        f"SELECT x.i, x.d, x.x, sum(exp(t.el) * exp(b.el)) AS rate FROM {x} x "
        f"JOIN {theta} t ON t.i = x.i JOIN {beta} b ON b.d = x.d AND b.k = t.k GROUP BY x.i, x.d, x.x"
    )


def shares(key: str, theta: str, beta: str, rate: str) -> str:
    return (
        f"SELECT q.{key}, t.k, sum(q.x / q.rate * exp(t.el) * exp(b.el)) AS s FROM {rate} q "
        f"JOIN {theta} t ON t.i = q.i JOIN {beta} b ON b.d = q.d AND b.k = t.k GROUP BY q.{key}, t.k"
    )


def scale(theta: str) -> str:
    return f"SELECT count(*) / sum(e) AS c FROM {theta}"


def theta_step(n: str, theta: str, beta: str, c: str, rows: str = "rows", x: str = "x") -> list[tuple[str, str]]:
    """Makes theta_n and c_n."""
    return [
        (f"trate_{n}", rates(theta, beta, x)),
        (f"tstat_{n}", shares("i", theta, beta, f"trate_{n}")),
        (f"bsum_{n}", f"SELECT k, sum(e) AS total FROM {beta} GROUP BY k"),
        (
            f"theta_{n}",
            expected(
                f"SELECT i, k, {num(A)} + coalesce(s, 0e0) AS g, {num(A)} * (SELECT c FROM {c}) + total AS r "
                f"FROM {rows} CROSS JOIN bsum_{n} LEFT JOIN tstat_{n} USING (i, k)"
            ),
        ),
        (f"c_{n}", scale(f"theta_{n}")),
    ]


def beta_step(n: str, theta: str, beta: str) -> list[tuple[str, str]]:
    """Makes beta_n."""
    return [
        (f"brate_{n}", rates(theta, beta)),
        (f"bstat_{n}", shares("d", theta, beta, f"brate_{n}")),
        (f"tsum_{n}", f"SELECT k, sum(e) AS total FROM {theta} GROUP BY k"),
        (
            f"beta_{n}",
            expected(
                f"SELECT d, k, {num(B)} + coalesce(s, 0e0) AS g, {num(B)} + total AS r "
                f"FROM (SELECT d FROM cols) CROSS JOIN tsum_{n} LEFT JOIN bstat_{n} USING (d, k)"
            ),
        ),
    ]


def term(factors: str, shape: float, rate: str) -> str:
    return (
        f"(SELECT sum(({num(shape)} - g) * el - ({rate} - r) * e + lgamma(g) - g * ln(r)) FROM {factors})"
    )


def local_bound(theta: str, beta: str, c: str, x: str = "x") -> str:
    return f"""(
 (SELECT sum(x * ln(rate)) FROM ({rates(theta, beta, x)}))
 - (SELECT sum(t.s * b.s) FROM (SELECT k, sum(e) AS s FROM {theta} GROUP BY k) t
    JOIN (SELECT k, sum(e) AS s FROM {beta} GROUP BY k) b USING (k))
 + {term(theta, A, f"{num(A)} * (SELECT c FROM {c})")}
 + (SELECT count(*) FROM {theta}) * {num(A)} * ln((SELECT c FROM {c})))"""


def bound(theta: str, beta: str, c: str) -> str:
    return f"{local_bound(theta, beta, c)} + {term(beta, B, num(B))}"


START = [
    *COUNTS,
    ("theta_s", drawn("theta", "rows", "i")),
    ("beta_s", drawn("beta", "cols", "d")),
    ("c_s", scale("theta_s")),
]
ONE_THETA = [*START, *theta_step("1", "theta_s", "beta_s", "c_s")]
ONE_STEP = [*ONE_THETA, *beta_step("1", "theta_1", "beta_s")]


def factor_rows(table: str, key: str, columns: str) -> str:
    picked = ", ".join(f"{r6(c)} AS {c}" for c in columns.split())
    return f"SELECT {key}, k::INTEGER AS k, {picked} FROM {table}"


ORACLES["init_factors"] = with_all(START, factor_rows("theta_s", "i", "g r"))
ORACLES["set_components"] = with_all(START, factor_rows("beta_s", "d", "e el") + " WHERE d < 75")
ORACLES["gamma_expectations"] = with_all(
    [
        *COUNTS,
        ("gr", "SELECT i, 0 AS k, sum(x) + 1e-1 AS g, count(*) + 5e-1 AS r FROM x GROUP BY i"),
        ("ge", expected("SELECT * FROM gr")),
    ],
    factor_rows("ge", "i", "e el"),
)
ORACLES["rate_at_nonzeros"] = with_all(
    START, f"SELECT i, d, x, {r6('rate')} AS rate FROM ({rates('theta_s', 'beta_s')})"
)
ORACLES["update_theta"] = with_all(ONE_THETA, factor_rows("theta_1", "i", "g r e el"))
ORACLES["update_beta"] = with_all(ONE_STEP, factor_rows("beta_1", "d", "g r e el"))
ORACLES["scale_c"] = with_all(ONE_THETA, f"SELECT {r6('c')} AS c FROM c_1")
ORACLES["gamma_term"] = with_all(ONE_THETA, f"SELECT {r6(term('theta_1', A, num(A)), 3)} AS term")
ORACLES["elbo"] = with_all(ONE_STEP, f"SELECT {r6(bound('theta_1', 'beta_1', 'c_1'), 3)} AS bound")

FITTED = ONE_STEP
for n in range(2, t.MODEL.max_iter + 1):
    FITTED = [
        *FITTED,
        *theta_step(f"{n}", f"theta_{n - 1}", f"beta_{n - 1}", f"c_{n - 1}"),
        *beta_step(f"{n}", f"theta_{n}", f"beta_{n - 1}"),
    ]
LAST = t.MODEL.max_iter
ORACLES["pmf_fit"] = ORACLES["pmf_fit_by_joins"] = with_all(FITTED, factor_rows(f"beta_{LAST}", "d", "g r e"))
ORACLES["pmf_fit_weights"] = with_all(FITTED, factor_rows(f"theta_{LAST}", "i", "g r e"))
ORACLES["pmf_fit_bounds"] = with_all(
    FITTED,
    "\nUNION ALL ".join(
        f"SELECT {n - 1} AS step, {r6(bound(f'theta_{n}', f'beta_{n}', f'c_{n}'), 3)} AS bound"
        for n in range(1, LAST + 1)
    ),
)
ORACLES["pmf_transform"] = with_all(
    [*ONE_THETA, *theta_step("2", "theta_1", "beta_s", "c_1")], factor_rows("theta_2", "i", "e")
)


def scores(theta: str, beta: str) -> str:
    return f"SELECT t.i, b.d, sum(t.e * b.e) AS score FROM {theta} t JOIN {beta} b USING (k) GROUP BY t.i, b.d"


ORACLES["score_tags"] = with_all(START, f"SELECT i, d, {r6('score')} AS score FROM ({scores('theta_s', 'beta_s')})")
ORACLES["score_tags_top"] = ORACLES["score_tags_blocks"] = with_all(
    START,
    f"SELECT i, d, {r6('score')} AS score FROM ({scores('theta_s', 'beta_s')}) "
    "QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, d) <= 5",
)
ORACLES["recommend_groups"] = with_all(
    FITTED,
    f"SELECT i, label, {r6('score')} AS score FROM ({scores(f'theta_{LAST}', f'beta_{LAST}')}) JOIN cols USING (d) "
    "QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, d) <= 3",
)

# Stochastic factorization: one pass over two batches

SHUFFLED_ROWS = "SELECT i, row_number() OVER (ORDER BY md5('0:0:' || i), i) - 1 AS position FROM rows"
ORACLES["minibatch_split"] = with_all(
    COUNTS, f"SELECT i, position // 100 AS batch FROM ({SHUFFLED_ROWS})"
)
SIZE = "(SELECT ceil(count(*) / 2) FROM rows)"
SCALE = f"((SELECT count(*) FROM rows) / {SIZE})"


def gradient_step(tag: str, beta: str, step: int, rows: str, x: str, size: str, total: str,
                  inner: int = 1) -> list[tuple[str, str]]:
    """Makes beta_<tag> from a fold-in of the rows and counts given as SQL, with ``inner`` iterations."""
    rho = (step + t.MODEL.t0) ** (-t.MODEL.kappa)
    scaling = f"({total} / {size})"
    steps = [
        (f"rows_{tag}", rows),
        (f"x_{tag}", x),
        (f"start_{tag}", f"SELECT * FROM theta_s WHERE i IN (SELECT i FROM rows_{tag})"),
        (f"c0_{tag}", scale(f"start_{tag}")),
    ]
    theta, c = f"start_{tag}", f"c0_{tag}"
    for n in range(1, inner + 1):
        name = tag if n == inner else f"{tag}_{n}"
        steps += theta_step(name, theta, beta, c, f"rows_{tag}", f"x_{tag}")
        theta, c = f"theta_{name}", f"c_{name}"
    steps += [
        (f"grate_{tag}", rates(f"theta_{tag}", beta, f"x_{tag}")),
        (f"gstat_{tag}", shares("d", f"theta_{tag}", beta, f"grate_{tag}")),
        (f"gsum_{tag}", f"SELECT k, sum(e) AS total FROM theta_{tag} GROUP BY k"),
    ]
    moved = (
        f"SELECT d, k, {num(1 - rho)} * b.g + {num(rho)} * ({num(B)} + {scaling} * coalesce(s, 0e0)) AS g, "
        f"{num(1 - rho)} * b.r + {num(rho)} * ({num(B)} + {scaling} * total) AS r "
        f"FROM {beta} b JOIN gsum_{tag} USING (k) LEFT JOIN gstat_{tag} USING (d, k)"
    )
    return [*steps, (f"beta_{tag}", expected(moved))]


def half_step(n: int, beta: str) -> list[tuple[str, str]]:
    """The gradient step on half n - 1 of the shuffled rows."""
    return gradient_step(
        f"g{n}",
        beta,
        n,
        f"SELECT i FROM positions WHERE position // {SIZE}::BIGINT = {n - 1}",
        f"SELECT * FROM x WHERE i IN (SELECT i FROM rows_g{n})",
        SIZE,
        "(SELECT count(*) FROM rows)",
    )


def step_bound(n: int) -> str:
    tag = f"g{n}"
    local = local_bound(f"theta_{tag}", f"beta_{tag}", f"c_{tag}", f"x_{tag}")
    return f"{SCALE} * {local} + {term(f'beta_{tag}', B, num(B))}"


FIRST = [*START, ("positions", SHUFFLED_ROWS), *half_step(1, "beta_s")]
BOTH = [*FIRST, *half_step(2, "beta_g1")]
ORACLES["pmf_partial_fit"] = with_all(FIRST, factor_rows("beta_g1", "d", "g r e"))
ORACLES["stochastic_elbo"] = with_all(FIRST, f"SELECT 0 AS step, {r6(step_bound(1), 3)} AS bound")
ORACLES["online_pmf_fit"] = with_all(BOTH, factor_rows("beta_g2", "d", "g r e"))
ORACLES["online_pmf_bounds"] = with_all(
    BOTH,
    "\nUNION ALL ".join(
        f"SELECT 0 AS pass, {n - 1} AS batch, {r6(step_bound(n), 3)} AS bound" for n in (1, 2)
    ),
)

# Streams: five micro-batches in order

USERS = "(SELECT count(*) FROM rows)"
FEED = [
    ("cols", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS d "
     "FROM (SELECT DISTINCT event_type AS label FROM events)"),
    ("rows", "SELECT DISTINCT user_id AS i FROM events"),
    ("ks", f"SELECT unnest(range({K})) AS k"),
    ("theta_s", drawn("theta", "rows", "i")),
    ("beta_s", drawn("beta", "cols", "d")),
]


def fed(whole: bool) -> list[tuple[str, str]]:
    """The five steps; with ``whole`` each learns from all events so far of the users in its fifth."""
    steps = list(FEED)
    for n in range(1, 6):
        fifth = f"FROM events JOIN cols ON event_type = label WHERE event_id % 5 = {n - 1}"
        so_far = (
            f"FROM events JOIN cols ON event_type = label WHERE event_id % 5 < {n} "
            f"AND user_id IN (SELECT user_id FROM events WHERE event_id % 5 = {n - 1})"
        )
        steps += gradient_step(
            f"f{n}",
            f"beta_f{n - 1}" if n > 1 else "beta_s",
            n,
            f"SELECT DISTINCT user_id AS i {fifth}",
            f"SELECT user_id AS i, d, count(*)::DOUBLE AS x {so_far if whole else fifth} GROUP BY ALL",
            f"ceil({USERS} / 2)",
            USERS,
            inner=2,
        )
    return steps


ORACLES["stream_pmf_whole_rows"] = with_all(fed(True), factor_rows("beta_f5", "d", "g r e"))
ORACLES["stream_pmf"] = with_all(fed(False), factor_rows("beta_f5", "d", "g r e"))

FIFTHS = [
    *POINTS,
    ("fifth_0", "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 = 0"),
    *seeded_batch("b0", "fifth_0", SEEDS, "vec_id"),
]
for n in range(1, 5):
    FIFTHS += [
        (f"long_fifth_{n}", f"SELECT * FROM p WHERE id % 5 = {n}"),
        *add_batch(f"b{n}", f"long_fifth_{n}", f"b{n - 1}"),
    ]
ORACLES["stream_codebook"] = with_all(FIFTHS, book_rows("b4"))

# Evaluation


def luck(tag: str) -> str:
    digest = f"md5('{tag}:' || doc_id)"
    return f"floor({uniform(digest)} * 50) / 10e0"


JUDGED = [
    (
        "truth",
        "SELECT DISTINCT doc_id AS item, 'quality' AS tag FROM labels WHERE quality = 1 "
        "UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 "
        "UNION SELECT doc_id, 'clean' FROM labels WHERE toxic = 0",
    ),
    ("judged_docs", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    (
        "scores",
        "SELECT doc_id AS item, 'quality' AS tag, n_chars / 1000e0 AS score FROM judged_docs "
        f"UNION ALL SELECT doc_id, 'toxic', {luck('toxic')} FROM judged_docs "
        f"UNION ALL SELECT doc_id, 'clean', {luck('clean')} FROM judged_docs",
    ),
    ("best", "SELECT *, (row_number() OVER (PARTITION BY item ORDER BY score DESC, tag))::INTEGER AS rank FROM scores QUALIFY rank <= 2"),
    (
        "judged",
        "SELECT s.*, CASE WHEN u.item IS NULL THEN 0 ELSE 1 END AS hit "
        "FROM scores s LEFT JOIN truth u ON u.item = s.item AND u.tag = s.tag",
    ),
]
ORACLES["topk_tags"] = with_all(JUDGED, "SELECT item, tag, score, rank FROM best")
ORACLES["precision_recall_at_k"] = with_all(
    JUDGED,
    f"""SELECT tag, n_predicted, n_true, n_hits, {r6('n_hits / nullif(n_predicted, 0)')} AS precision,
 {r6('n_hits / nullif(n_true, 0)')} AS recall, {r6('2 * n_hits / nullif(n_predicted + n_true, 0)')} AS f1
FROM (SELECT coalesce(p.tag, u.tag) AS tag, count(p.item) AS n_predicted, count(u.item) AS n_true,
      count(CASE WHEN p.item IS NOT NULL AND u.item IS NOT NULL THEN 1 END) AS n_hits
      FROM best p FULL JOIN truth u ON p.item = u.item AND p.tag = u.tag GROUP BY 1)""",
)
# every pair of a hit and a miss, a tie counting half
ORACLES["tag_auc"] = with_all(
    JUDGED,
    f"""SELECT tag, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, {r6('won / nullif(n_pos * n_neg, 0)')} AS auc
FROM (SELECT tag, sum(hit) AS n_pos, sum(1 - hit) AS n_neg FROM judged GROUP BY tag)
LEFT JOIN (SELECT p.tag, sum(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0e0 END) AS won
      FROM judged p JOIN judged n ON p.tag = n.tag AND p.hit = 1 AND n.hit = 0 GROUP BY p.tag) USING (tag)""",
)
PRECISION = [
    *JUDGED,
    (
        "curve",
        "SELECT tag, score, sum(hit) AS hits, sum(sum(hit)) OVER w AS found, sum(count(*)) OVER w AS seen "
        "FROM judged GROUP BY tag, score WINDOW w AS (PARTITION BY tag ORDER BY score DESC)",
    ),
    (
        "ap",
        "SELECT tag, sum(hits)::BIGINT AS n_pos, sum(hits * found / seen) / nullif(sum(hits), 0) AS ap "
        "FROM curve GROUP BY tag",
    ),
]
ORACLES["average_precision"] = with_all(PRECISION, f"SELECT tag, n_pos, {r6('ap')} AS ap FROM ap")
ORACLES["mean_average_precision"] = with_all(PRECISION, f"SELECT {r6('avg(ap)')} AS mean_ap FROM ap")
