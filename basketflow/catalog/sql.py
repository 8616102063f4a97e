"""Named SQL pieces the checks share; ``sql`` puts the needed ones in front of a query."""

from __future__ import annotations

from basketflow.functions.text import NON_PRODUCT_PATTERNS

PATTERNS = "|".join(NON_PRODUCT_PATTERNS)
P = 2147483647


def mixed(seed: str, *cols: str) -> str:
    """The arithmetic of ``functions.mixing.mix`` as an SQL expression."""
    value = f"(CAST({seed} AS BIGINT) % {P})"
    for col in cols:
        value = f"(({value} + ({col}) % {P}) % {P})"
        value = f"(({value} * 48271 + 11) % {P})"
        value = f"((({value} * {value}) % {P} * 16807 + {value}) % {P})"
    return value


PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
ONCE: set[str] = set()  # parts that are computed once, however often they are read


def part(name: str, needs: str, body: str, once: bool = False) -> None:
    PARTS[name] = (tuple(needs.split()), body)
    if once:
        ONCE.add(name)


def sql(needs: str, body: str) -> str:
    chosen: list[str] = []

    def add(name: str) -> None:
        if name in chosen:
            return
        for other in PARTS[name][0]:
            add(other)
        chosen.append(name)

    for name in needs.split():
        add(name)
    if not chosen:
        return body
    kept = lambda n: "MATERIALIZED " if n in ONCE else ""
    return "WITH " + ",\n".join(f"{n} AS {kept(n)}({PARTS[n][1]})" for n in chosen) + "\n" + body


# ---- sales lines ------------------------------------------------------------------------------
part("raw", "", """
SELECT CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description, o_custkey AS customer_id,
       l_quantity AS quantity, l_extendedprice AS line_amount, o_orderdate AS invoice_date, n_name AS country,
       p_brand AS brand, p_type AS category, CAST(l_suppkey AS VARCHAR) AS vendor,
       CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS unique_transaction
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
part("priced", "raw", "SELECT *, CASE WHEN quantity <> 0 THEN line_amount / quantity END AS price FROM raw")
part("valid", "priced", """
SELECT DISTINCT * FROM priced
WHERE invoice_date IS NOT NULL AND stock_code IS NOT NULL AND description IS NOT NULL AND country IS NOT NULL
  AND customer_id IS NOT NULL AND NOT starts_with(unique_transaction, 'C') AND quantity > 0 AND price > 0""")
part("products", "valid", f"""
SELECT * REPLACE (upper(regexp_replace(trim(description), '\\s+', ' ', 'g')) AS description, upper(stock_code) AS stock_code)
FROM valid WHERE NOT regexp_matches(description, '(?i){PATTERNS}')""")
part("merged", "products", """
SELECT customer_id, stock_code, invoice_date, sum(quantity) AS quantity, sum(quantity * price) AS line_amount,
       min(description) AS description, min(country) AS country, min(brand) AS brand, min(category) AS category,
       min(vendor) AS vendor, sum(quantity * price) / sum(quantity) AS price
FROM products GROUP BY customer_id, stock_code, invoice_date""")


def bounds_of(source: str, multiplier: float = 3.0) -> str:
    cols = []
    for c in ("price", "quantity", "line_amount"):
        q = lambda p: f"quantile_cont(ln(greatest({c}, 1e-6)), {p})"
        cols.append(f"exp({q(0.25)} - {multiplier} * ({q(0.75)} - {q(0.25)})) AS {c}_lo")
        cols.append(f"exp({q(0.75)} + {multiplier} * ({q(0.75)} - {q(0.25)})) AS {c}_hi")
    return f"SELECT {', '.join(cols)} FROM {source}"


INSIDE = ("price BETWEEN price_lo AND price_hi AND quantity BETWEEN quantity_lo AND quantity_hi "
          "AND line_amount BETWEEN line_amount_lo AND line_amount_hi")
part("bounds", "merged", bounds_of("merged"))
part("clean", "merged bounds", f"SELECT merged.* FROM merged, bounds WHERE {INSIDE}")
part("items", "clean", """
SELECT c.stock_code, d.value AS description, median(price) AS price_median, avg(price) AS price_mean,
       count(*) AS popularity, b.value AS brand, g.value AS category, v.value AS vendor
FROM clean c
JOIN (SELECT stock_code, arg_min(description, (-n, description)) AS value FROM
      (SELECT stock_code, description, count(*) AS n FROM clean GROUP BY ALL) GROUP BY 1) d ON d.stock_code = c.stock_code
JOIN (SELECT stock_code, arg_min(brand, (-n, brand)) AS value FROM
      (SELECT stock_code, brand, count(*) AS n FROM clean GROUP BY ALL) GROUP BY 1) b ON b.stock_code = c.stock_code
JOIN (SELECT stock_code, arg_min(category, (-n, category)) AS value FROM
      (SELECT stock_code, category, count(*) AS n FROM clean GROUP BY ALL) GROUP BY 1) g ON g.stock_code = c.stock_code
JOIN (SELECT stock_code, arg_min(vendor, (-n, vendor)) AS value FROM
      (SELECT stock_code, vendor, count(*) AS n FROM clean GROUP BY ALL) GROUP BY 1) v ON v.stock_code = c.stock_code
GROUP BY c.stock_code, d.value, b.value, g.value, v.value""")
part("item_map", "clean", """
SELECT stock_code, row_number() OVER (ORDER BY stock_code) - 1 AS item_idx FROM (SELECT DISTINCT stock_code FROM clean)""")
part("customer_map", "clean", """
SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS user_idx FROM (SELECT DISTINCT customer_id FROM clean)""")

# ---- event lines ------------------------------------------------------------------------------
part("ev", "", """
SELECT event_id, user_id AS customer_id, user_id AS user_idx, ts, event_type AS country,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_idx FROM events""")
part("cutoffs", "ev", "SELECT quantile_cont(epoch_us(ts), 0.8) AS q80, quantile_cont(epoch_us(ts), 0.9) AS q90 FROM ev")
part("seq", "ev cutoffs", """
SELECT event_id AS query_id, customer_id, user_idx, ts, item_idx AS pos_item_idx, history, last_country AS country,
       CASE WHEN epoch_us(ts) < q80 THEN 'train' WHEN epoch_us(ts) < q90 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, list(item_idx) OVER (PARTITION BY user_idx ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS history,
             last_value(country) OVER (PARTITION BY user_idx ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_country
      FROM ev), cutoffs WHERE len(history) >= 2""")
part("train", "seq", "SELECT * FROM seq WHERE split = 'train'")
# Parts that belong to one evaluated split: those of the test split have no prefix.
SPLITS = {"": "test", "val_": "val"}
for _p, _split in SPLITS.items():
    part(f"{_p}tests", "seq", f"SELECT query_id, user_idx, history, pos_item_idx, ts FROM seq WHERE split = '{_split}'")
    part(f"{_p}users", f"{_p}tests", f"SELECT DISTINCT user_idx FROM {_p}tests")
    part(f"{_p}truths", f"{_p}tests", f"SELECT query_id, pos_item_idx AS truth FROM {_p}tests")
part("mat", "train", """
SELECT user_idx, item_idx, sum(w) AS weight FROM (
  SELECT user_idx, pos_item_idx AS item_idx, 1.0::DOUBLE AS w FROM train
  UNION ALL SELECT user_idx, unnest(history), 0.5::DOUBLE FROM train) GROUP BY ALL""")
part("knn", "ev train", """
SELECT user_idx, item_idx, count(*)::DOUBLE AS weight FROM ev WHERE ts <= (SELECT max(ts) FROM train) GROUP BY ALL""")
part("all_items", "ev", "SELECT DISTINCT item_idx FROM ev")


def similarity(name: str, source: str, ident: str, key: str) -> None:
    """Cosine of all pairs that share a key, both directions."""
    part(f"{name}_len", source, f"SELECT {ident} AS id, sqrt(sum(weight * weight)) AS length FROM {source} GROUP BY 1")
    part(name, f"{source} {name}_len", f"""
SELECT x.{ident} AS a, y.{ident} AS b, sum(x.weight * y.weight) / (any_value(la.length) * any_value(lb.length)) AS similarity
FROM {source} x JOIN {source} y ON x.{key} = y.{key} AND x.{ident} <> y.{ident}
JOIN {name}_len la ON la.id = x.{ident} JOIN {name}_len lb ON lb.id = y.{ident} GROUP BY 1, 2""")


similarity("isim", "mat", "item_idx", "user_idx")
similarity("ksim", "knn", "item_idx", "user_idx")
similarity("usim", "mat", "user_idx", "item_idx")


def top(source: str, k: int, key: str = "query_id", score: str = "score") -> str:
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, item_idx) AS rank, item_idx, score
FROM {source} QUALIFY rank <= {k}"""


part("pop", "mat", "SELECT item_idx, sum(weight) AS pop FROM mat GROUP BY 1")


def item_knn(name: str, profile: str, base: str, sim: str, alpha: float, users: str = "users") -> None:
    part(f"{name}_pop", base, f"""
SELECT item_idx, sum(weight) / max(sum(weight)) OVER () AS pop FROM {base} GROUP BY item_idx""")
    part(f"{name}_scores", f"{users} {profile} {sim} {name}_pop", f"""
SELECT u.user_idx, p.item_idx, round(coalesce(s.score, 0) + {alpha} * p.pop, 9) AS score, coalesce(s.score, 0) AS raw_score
FROM {users} u CROSS JOIN {name}_pop p
LEFT JOIN (SELECT f.user_idx, s.b AS item_idx, sum(f.weight * s.similarity) AS score
           FROM {profile} f JOIN {sim} s ON s.a = f.item_idx GROUP BY 1, 2) s
  ON s.user_idx = u.user_idx AND s.item_idx = p.item_idx
WHERE NOT EXISTS (SELECT 1 FROM {profile} m WHERE m.user_idx = u.user_idx AND m.item_idx = p.item_idx AND m.weight > 0)""")
    part(f"{name}_recs", f"{name}_scores", top(f"{name}_scores", 20, "user_idx"))


def factors(name: str, source: str, rank: int, rounds: int, steps: int, seed: int = 42) -> None:
    """Non-negative factors of a whole table by multiplicative updates from a start that a rule gives: (id, k, x) and the losses."""
    ids = {"w": "user_idx", "h": "item_idx"}
    part(f"{name}_size", source, f"""
SELECT count(DISTINCT user_idx) AS n_users, count(DISTINCT item_idx) AS n_items, sum(weight) AS total, sum(weight * weight) AS squares FROM {source}""", True)
    for turn, (side, ident) in enumerate(ids.items()):
        part(f"{name}_{side}", f"{source} {name}_size", f"""
SELECT {ident}, k, ({mixed(str(seed + turn), ident, 'k')} / 2147483647.0::DOUBLE + 0.5) * sqrt(total / (n_users * n_items) / {rank}) AS x
FROM (SELECT DISTINCT {ident} FROM {source} WHERE weight <> 0), range({rank}) r(k), {name}_size""", True)
    now = {side: f"{name}_{side}" for side in ids}
    losses = []

    def gram(side: str) -> str:
        out = f"{now[side]}_gram"
        part(out, now[side], f"SELECT a.k, b.k AS l, sum(a.x * b.x) AS g FROM {now[side]} a JOIN {now[side]} b USING ({ids[side]}) GROUP BY ALL", True)
        return out

    def loss(round_: int) -> None:
        # over all cells: squares of the table, less twice the products at its cells, plus those of the factors
        grams = gram("w"), gram("h")
        out = f"{name}_loss{round_}"
        part(out, f"{source} {now['w']} {now['h']} {' '.join(grams)} {name}_size", f"""
SELECT {round_}::BIGINT AS round, squares - 2 * (SELECT sum(c.weight * w.x * h.x) FROM {source} c JOIN {now['w']} w USING (user_idx) JOIN {now['h']} h
  ON h.item_idx = c.item_idx AND h.k = w.k) + (SELECT sum(a.g * b.g) FROM {grams[0]} a JOIN {grams[1]} b USING (k, l)) AS loss FROM {name}_size""")
        losses.append(out)

    loss(0)
    for round_ in range(1, rounds + 1):
        for side, other in (("w", "h"), ("h", "w")):
            ident, fixed = ids[side], now[other]
            products, grams = f"{name}_{side}{round_}_products", gram(other)
            part(products, f"{source} {fixed}", f"SELECT c.{ident}, f.k, sum(c.weight * f.x) AS n FROM {source} c JOIN {fixed} f USING ({ids[other]}) GROUP BY ALL", True)
            for step in range(steps):
                out = f"{name}_{side}{round_}_{step}"
                part(out, f"{now[side]} {products} {grams}", f"""
SELECT x.{ident}, x.k, x.x * n.n / greatest(d.d, 1e-12) AS x FROM {now[side]} x JOIN {products} n USING ({ident}, k)
JOIN (SELECT y.{ident}, g.l AS k, sum(y.x * g.g) AS d FROM {now[side]} y JOIN {grams} g ON g.k = y.k GROUP BY ALL) d USING ({ident}, k)""", True)
                now[side] = out
        loss(round_)
    part(f"{name}_users", now["w"], f"SELECT * FROM {now['w']}")
    part(f"{name}_items", now["h"], f"SELECT * FROM {now['h']}")
    part(f"{name}_losses", " ".join(losses), " UNION ALL ".join(f"SELECT * FROM {t}" for t in losses))


# What the queries fit: the rank of the operator's default, and few rounds, so that SQL can follow.
FACTOR_RANK, FACTOR_ROUNDS, FACTOR_STEPS = 50, 6, 5
factors("mf", "mat", FACTOR_RANK, FACTOR_ROUNDS, FACTOR_STEPS)
for _p in SPLITS:
    part(f"{_p}pop_scores", f"{_p}users pop mat", f"""
SELECT u.user_idx, p.item_idx, p.pop AS score FROM {_p}users u, pop p
WHERE NOT EXISTS (SELECT 1 FROM mat m WHERE m.user_idx = u.user_idx AND m.item_idx = p.item_idx AND m.weight <> 0)""")
    part(f"{_p}pop_recs", f"{_p}pop_scores", top(f"{_p}pop_scores", 20, "user_idx"))
    item_knn(f"{_p}iknn", "knn", "knn", "ksim", 0.01, f"{_p}users")
    part(f"{_p}uknn_near", f"usim {_p}users", f"""
SELECT a AS user_idx, b AS neighbor, similarity,
       row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b) AS rank
FROM usim SEMI JOIN {_p}users u ON u.user_idx = usim.a WHERE similarity > 0 QUALIFY rank <= 50""")
    part(f"{_p}uknn_scores", f"{_p}uknn_near mat", f"""
SELECT n.user_idx, m.item_idx, round(sum(n.similarity * m.weight), 9) AS score
FROM {_p}uknn_near n JOIN mat m ON m.user_idx = n.neighbor
WHERE NOT EXISTS (SELECT 1 FROM mat s WHERE s.user_idx = n.user_idx AND s.item_idx = m.item_idx AND s.weight <> 0)
GROUP BY 1, 2 HAVING sum(n.similarity * m.weight) > 0""")
    part(f"{_p}uknn_recs", f"{_p}uknn_scores", top(f"{_p}uknn_scores", 20, "user_idx"))
    part(f"{_p}mf_scores", f"{_p}users mf_users mf_items mat", f"""
SELECT w.user_idx, h.item_idx, round(sum(w.x * h.x), 9) AS score
FROM {_p}users u JOIN mf_users w USING (user_idx) JOIN mf_items h USING (k)
WHERE NOT EXISTS (SELECT 1 FROM mat m WHERE m.user_idx = w.user_idx AND m.item_idx = h.item_idx AND m.weight <> 0) GROUP BY 1, 2""")
    part(f"{_p}mf_recs", f"{_p}mf_scores", top(f"{_p}mf_scores", 20, "user_idx"))
    part(f"{_p}lists", f"{_p}pop_recs {_p}iknn_recs {_p}uknn_recs {_p}mf_recs {_p}tests", " UNION ALL ".join(
        f"SELECT '{_name}' AS model, query_id, rank, item_idx FROM {_p}tests JOIN {_p}{_recs}_recs USING (user_idx)"
        for _name, _recs in (("Popularity", "pop"), ("ItemKNN", "iknn"), ("UserKNN", "uknn"), ("MatrixFactorization", "mf"))))


# ---- metrics ----------------------------------------------------------------------------------
def metrics(lists: str, truths: str, ks: tuple[int, ...], n_items: str | None = "(SELECT count(*) FROM all_items)") -> str:
    """Rows (model, metric, k, value) over lists (model, query_id, rank, item_idx)."""
    k = f"(SELECT unnest([{', '.join(map(str, ks))}])::BIGINT AS k)"
    ranks = f"""SELECT m.model, t.query_id, min(l.rank) AS hit
FROM (SELECT DISTINCT model FROM {lists}) m CROSS JOIN {truths} t
LEFT JOIN {lists} l ON l.model = m.model AND l.query_id = t.query_id AND l.item_idx = t.truth GROUP BY 1, 2"""
    out = f"""
SELECT model, metric, k, round(value, 6) AS value FROM (
  SELECT model, k, avg(CASE WHEN hit <= k THEN 1.0 ELSE 0.0 END) AS "Recall",
         avg(CASE WHEN hit <= k THEN 1.0 / log2(hit + 1) ELSE 0.0 END) AS "NDCG",
         avg(CASE WHEN hit <= k THEN 1.0 / hit ELSE 0.0 END) AS "MRR"
  FROM ({ranks}) r CROSS JOIN {k} ks GROUP BY 1, 2) UNPIVOT (value FOR metric IN ("Recall", "NDCG", "MRR"))"""
    if n_items:
        out += f"""
UNION ALL SELECT model, 'Coverage', k, round(count(DISTINCT CASE WHEN rank <= k THEN item_idx END) / {n_items}::DOUBLE, 6)
FROM {lists} CROSS JOIN {k} ks GROUP BY 1, 3"""
    return out


# ---- vectors ----------------------------------------------------------------------------------
part("vec", "", """
SELECT vec_id AS item_idx, embedding::DOUBLE[] AS v,
       [x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8) FOR x IN embedding::DOUBLE[]] AS u
FROM embeddings""")


def history_vectors(name: str, source: str) -> None:
    part(f"{name}_mean", f"{source} vec", f"""
SELECT query_id, list(m ORDER BY d) AS v FROM (
  SELECT query_id, d, avg(x) AS m FROM (
    SELECT h.query_id, unnest(vec.v) AS x, unnest(range(len(vec.v))) AS d
    FROM (SELECT query_id, unnest(history[-15:]) AS item_idx FROM {source}) h JOIN vec USING (item_idx)) GROUP BY 1, 2)
GROUP BY 1""")
    part(name, f"{name}_mean", f"""
SELECT query_id, [x / greatest(sqrt(list_dot_product(v, v)), 1e-8) FOR x IN v] AS v FROM {name}_mean""")


history_vectors("hv", "seq")
for _p in SPLITS:
    history_vectors(f"{_p}tv", f"{_p}tests")
part("near_scores", "hv vec", "SELECT query_id, item_idx, round(list_dot_product(hv.v, vec.u), 9) AS score FROM hv, vec")
for _p in SPLITS:
    part(f"{_p}test_scores", f"{_p}tv vec", f"SELECT query_id, item_idx, round(list_dot_product(t.v, vec.u), 9) AS score FROM {_p}tv t, vec")
K_CANDS = 200


def candidates(name: str, scores: str, source: str, k: int) -> None:
    part(f"{name}_top", scores, top(scores, k))
    part(name, f"{name}_top {source}", f"""
SELECT s.query_id, s.history, s.pos_item_idx, s.ts,
       CASE WHEN list_contains(l.c, s.pos_item_idx) THEN l.c ELSE list_append(l.c[:{k - 1}], s.pos_item_idx) END AS cands
FROM {source} s JOIN (SELECT query_id, list(item_idx ORDER BY rank) AS c FROM {name}_top GROUP BY 1) l USING (query_id)""")


for _p in SPLITS:
    candidates(f"{_p}cands", f"{_p}test_scores", f"{_p}tests", K_CANDS)
part("pop_feat", "train", """
SELECT item_idx, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER () + 1e-9) AS pop
FROM (SELECT pos_item_idx AS item_idx, count(*) AS n FROM train GROUP BY 1)""")
part("price_feat", "items item_map", """
SELECT item_idx, (price_median - avg(price_median) OVER ()) / (stddev_samp(price_median) OVER () + 1e-6) AS price_z
FROM items JOIN item_map USING (stock_code) WHERE price_median IS NOT NULL""")


def features(name: str, cands: str, vectors: str, pop: str | None, price: str | None) -> None:
    need = " ".join(x for x in (cands, vectors, "vec", pop, price) if x)
    part(f"{name}_pairs", cands, f"""
SELECT query_id, history, pos_item_idx, unnest(cands) AS item_idx, unnest(range(len(cands))) AS slot FROM {cands}""")
    part(f"{name}_sims", f"{name}_pairs vec", f"""
SELECT p.query_id, p.item_idx, max(list_dot_product(c.u, h.u)) AS max_sim_recent
FROM (SELECT query_id, item_idx, unnest(history[-15:]) AS h FROM {name}_pairs) p
JOIN vec c ON c.item_idx = p.item_idx JOIN vec h ON h.item_idx = p.h GROUP BY 1, 2""")
    pop_col = "coalesce(pf.pop, 0)" if pop else "0.0::DOUBLE"
    price_col = "coalesce(zf.price_z, 0)" if price else "0.0::DOUBLE"
    part(name, need + f" {name}_pairs {name}_sims", f"""
SELECT p.query_id, p.item_idx, p.slot::BIGINT AS slot, list_dot_product(q.v, c.v) AS dot_uv, s.max_sim_recent, {pop_col} AS pop,
       least(len(p.history), 15) / 15.0::DOUBLE AS hist_len, {price_col} AS price_z,
       (p.item_idx = p.pos_item_idx)::INT::DOUBLE AS label
FROM {name}_pairs p JOIN {vectors} q USING (query_id) JOIN vec c ON c.item_idx = p.item_idx
JOIN {name}_sims s ON s.query_id = p.query_id AND s.item_idx = p.item_idx
{f'LEFT JOIN {pop} pf ON pf.item_idx = p.item_idx' if pop else ''}
{f'LEFT JOIN {price} zf ON zf.item_idx = p.item_idx' if price else ''}""")


for _p in SPLITS:
    features(f"{_p}feat", f"{_p}cands", f"{_p}tv", "pop_feat", "price_feat")


# ---- rankers ----------------------------------------------------------------------------------
def numbers(matrix) -> str:
    """A vector or matrix as an SQL list literal."""
    if getattr(matrix, "ndim", 1) == 2:
        return "[" + ", ".join(numbers(row) for row in matrix) + "]"
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in matrix) + "]"


def linear(x: str, layer) -> str:
    w, b = layer
    return f"[list_dot_product({numbers(w)}[i], {x}) + {numbers(b)}[i] FOR i IN range(1, {len(b) + 1})]"


def relu(x: str) -> str:
    return f"[greatest(t, 0) FOR t IN {x}]"


def normed(x: str, size: int) -> str:
    mean = f"(list_sum({x}) / {size})"
    var = f"(list_dot_product({x}, {x}) / {size} - {mean} * {mean})"
    return f"[(t - {mean}) / sqrt({var} + 1e-5) FOR t IN {x}]"


def added(x: str, y: str, size: int) -> str:
    return f"[{x}[i] + {y}[i] FOR i IN range(1, {size + 1})]"


def steps(source: str, start: str, columns: list[tuple[str, str]], keep: str = "query_id, item_idx, slot, label") -> str:
    """Nested SELECTs that add one list column after the other."""
    inner = f"SELECT {keep}, {start} AS x FROM {source}"
    for name, expr in columns:
        inner = f"SELECT *, {expr} AS {name} FROM ({inner})"
    return inner


X = "[dot_uv, max_sim_recent, pop, hist_len, price_z]"
