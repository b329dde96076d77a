"""Equivalent SQL: named parts, and a builder that puts those a query needs before it."""

from __future__ import annotations

import re

from tessera.operators.bias import kernel


def r(x: str, digits: int = 8) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def bucket(x: str, edges: list[float]) -> str:
    return f"CASE WHEN {x} BETWEEN {edges[0]} AND {edges[-1]} THEN least(len(list_filter({edges!r}, lambda e: e <= {x})) - 1, {len(edges) - 2}) END"


def clamped(x: str, edges: list[float]) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(len(list_filter({edges!r}, lambda e: e <= {x})) - 1, {len(edges) - 2})) END"


def smoothed(x: str, weights: list[float], over: str) -> str:
    half = len(weights) // 2
    terms = []
    for i, w in enumerate(weights):
        d = i - half
        near = x if d == 0 else f"{'lag' if d < 0 else 'lead'}({x}, {abs(d)}, 0.0::DOUBLE) OVER ({over})"
        terms.append(f"{near} * {w!r}")
    return f"coalesce({' + '.join(terms)}, {x})"


GC = [i / 10 for i in range(11)]
LENGTHS = [float(x) for x in range(100, 221, 10)]


def curve(rows: str, x: str, y: str, edges: list[float]) -> str:
    n = len(edges) - 1
    return f"""
        SELECT k.chrom, g.b::INT AS bucket, m.mean FROM (SELECT DISTINCT chrom FROM {rows}) k CROSS JOIN generate_series(0, {n - 1}) AS g(b)
        LEFT JOIN (SELECT chrom, {bucket(x, edges)} AS bk, avg({y}) AS mean FROM {rows} GROUP BY ALL) m ON m.chrom = k.chrom AND m.bk = g.b"""


def tiles(rows: str, col: str, size: int, stride: int, width: int = 60) -> str:
    first = f"(lo - CASE WHEN t > 0 THEN {size} - {stride} * t ELSE 0 END)"
    return f"""SELECT chrom, idx, v, t, greatest(0, least(floor((st - {first}) / {size})::BIGINT, ceil((hi - {first}) / {size})::BIGINT - 1)) AS mega
        FROM (SELECT chrom, idx, {col} AS v, idx * {width} AS st, min(idx * {width}) OVER (PARTITION BY chrom) AS lo, max(idx * {width}) OVER (PARTITION BY chrom) AS hi FROM {rows})
        CROSS JOIN generate_series(0, {size // stride - 1}) AS g(t)"""


START = "(epoch_us(ts) - 1704067200000000) // 60000000"
PARTS = {
    "reads": f"SELECT event_type AS chrom, {START} AS s, {START} + ceil(value)::BIGINT AS e, json_extract_string(props, '$.k')::INT AS mapq, user_id % 10 <> 0 AS pp, event_id % 2 = 0 AS r1, value AS tlen FROM events",
    "good": "SELECT * FROM reads WHERE mapq >= 20 AND s >= 0 AND e IS NOT NULL",
    "frags": "SELECT *, abs(tlen) AS len FROM good WHERE pp AND r1 AND abs(tlen) BETWEEN 100 AND 220",
    "touch": "SELECT *, greatest(0, least(e, (idx + 1) * 60) - greatest(s, idx * 60)) / 60.0::DOUBLE AS share FROM (SELECT *, unnest(generate_series(s // 60, e // 60)) AS idx FROM good)",
    "cov": "SELECT chrom, idx, sum(share) AS cov FROM touch GROUP BY ALL",
    "ftouch": "SELECT *, greatest(0, least(e, (idx + 1) * 60) - greatest(s, idx * 60)) / 60.0::DOUBLE AS share FROM (SELECT *, unnest(generate_series(s // 60, e // 60)) AS idx FROM frags)",
    "lens": "SELECT chrom, idx, sum(len * share) / nullif(sum(share), 0) AS mean_len FROM ftouch GROUP BY ALL",
    "spine": "SELECT chrom, i AS idx, (i * 37 % 101) / 100 AS gc FROM (SELECT DISTINCT event_type AS chrom FROM events) CROSS JOIN generate_series(0, 720) AS g(i)",
    "dense": "SELECT s.chrom, s.idx, s.gc, coalesce(c.cov, 0.0) AS cov FROM spine s LEFT JOIN cov c USING (chrom, idx)",
    "excl": "SELECT DISTINCT o_orderkey AS idx FROM orders WHERE o_orderkey < 721 AND (o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')",
    "bins": "SELECT * FROM spine WHERE idx NOT IN (SELECT idx FROM excl)",
    "al": f"SELECT b.chrom, b.idx, b.gc, {r('coalesce(c.cov, 0.0)', 2)} AS cov, {r('l.mean_len', 7)} AS mean_len FROM bins b LEFT JOIN cov c USING (chrom, idx) LEFT JOIN lens l USING (chrom, idx)",
    "zip": "SELECT chrom, count(*) AS n, avg(greatest(round_even(coalesce(cov, 0), 0), 0)) AS mu, count(*) FILTER (greatest(round_even(coalesce(cov, 0), 0), 0) <> 0) AS nonzero FROM al GROUP BY chrom",
    "pois": "SELECT chrom, k, nonzero / n AS p, exp(k * ln(mu) - mu - lgamma(k + 1)) AS f FROM zip CROSS JOIN generate_series(0, 2000) AS g(k) WHERE mu > 0",
    "limits": "SELECT chrom, coalesce(min(k) FILTER (p * (1 - c) < 1.0 / 263000000), 0) AS k FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY k) AS c FROM pois) GROUP BY chrom",
    "clipd": "SELECT al.*, CASE WHEN cov > k THEN k::DOUBLE ELSE cov END AS cov_clip, CASE WHEN NOT cov > k THEN cov END AS cov_raw FROM al JOIN limits USING (chrom)",
    "gccurve": curve("clipd", "gc", "cov_clip", GC),
    "gcends": "SELECT chrom, bucket, CASE WHEN bucket NOT IN (0, 9) THEN nullif(mean, 0) END AS f FROM gccurve",
    "gcsmooth": f"SELECT chrom, bucket, {smoothed('f', kernel(), 'PARTITION BY chrom ORDER BY bucket')} AS f FROM gcends",
    "gcf": "SELECT chrom, bucket, f / avg(f) OVER (PARTITION BY chrom) AS factor FROM gcsmooth",
    "gcdiv": "SELECT chrom, bucket, nullif((factor / avg(factor) OVER (PARTITION BY chrom))::REAL::DOUBLE, 0) AS d FROM gcf",
    "gcc": f"SELECT c.*, greatest(cov_clip, 0) / d AS cov_gc FROM (SELECT *, {clamped('gc', GC)} AS bk FROM clipd) c LEFT JOIN gcdiv g ON g.chrom = c.chrom AND g.bucket = c.bk",
    "tile": tiles("gcc", "cov_gc", 2880, 288),
    "tmean": "SELECT chrom, t, mega, avg(v) AS m FROM tile GROUP BY ALL",
    "mega": "SELECT chrom, idx, avg(m) AS mean, median(m) AS med FROM tile JOIN tmean USING (chrom, t, mega) GROUP BY ALL",
    "norm": "SELECT g.chrom, g.idx, CASE WHEN cov_gc < 0 THEN 0.0 ELSE cov_gc / (mean + 1e-10) END AS cov_norm FROM gcc g JOIN mega USING (chrom, idx)",
    "names": "SELECT chrom, row_number() OVER (ORDER BY chrom) - 1 AS k FROM (SELECT DISTINCT event_type AS chrom FROM events)",
    "mrows": "SELECT l_linestatus AS mask_type, l_suppkey AS supplier, chrom, l_orderkey % 721 AS idx, l_discount * 10 AS overlap FROM lineitem JOIN names ON l_partkey % 5 = k",
    "masks": f"SELECT mask_type, 'supp' || supplier AS cell_type, chrom, idx, overlap::REAL::DOUBLE AS y FROM (SELECT mask_type, supplier, chrom, idx, {r('max(overlap)', 2)} AS overlap FROM mrows GROUP BY ALL) WHERE overlap <> 0",
    "man": "SELECT DISTINCT mask_type, 'supp' || supplier AS cell_type, chrom FROM mrows",
    "consensus": f"SELECT mask_type, chrom, idx FROM (SELECT mask_type, chrom, idx, {r('max(overlap)', 2)} AS o FROM mrows WHERE supplier % 10 = 0 GROUP BY ALL) WHERE o >= 0.8",
    "types": "SELECT DISTINCT mask_type FROM man",
}


def sums_of(rows: str, x: str, keep: bool = False) -> dict[str, str]:
    """Parts for the dense definition of the six sums: every bin with every mask of the manifest."""
    gone = "" if keep else "AND NOT EXISTS (SELECT 1 FROM consensus c WHERE c.mask_type = m.mask_type AND c.chrom = b.chrom AND c.idx = b.idx)"
    return {
        "xrows": f"SELECT m.mask_type, b.chrom, b.idx, b.{x} AS x FROM {rows} b CROSS JOIN types m WHERE b.{x} IS NOT NULL {gone}",
        "xper": "SELECT mask_type, chrom, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM xrows GROUP BY ALL",
        "wide": "SELECT mask_type, cell_type, sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sxx) AS sxx FROM man JOIN xper USING (mask_type, chrom) GROUP BY ALL",
        "near": "SELECT mask_type, cell_type, sum(y) AS sy, sum(y * y) AS syy, sum(x * y) AS sxy FROM masks JOIN xrows USING (mask_type, chrom, idx) GROUP BY ALL",
        "sums": "SELECT mask_type, cell_type, n, sx, sxx, coalesce(sy, 0) AS sy, coalesce(syy, 0) AS syy, coalesce(sxy, 0) AS sxy FROM wide LEFT JOIN near USING (mask_type, cell_type)",
        "feat": """SELECT mask_type, cell_type,
            CASE WHEN n < 2 THEN 0.0 ELSE coalesce(greatest(-1, least(1, (n * sxy - sx * sy) / nullif(sqrt(greatest(n * sxx - sx * sx, 0)) * sqrt(greatest(n * syy - sy * sy, 0)), 0))), 0.0) END AS pearson_r,
            CASE WHEN n < 2 THEN 0.0 ELSE sxy / n END AS fraction_within,
            CASE WHEN n < 2 THEN 0.0 ELSE coalesce(greatest(-1, least(1, sxy / nullif(sqrt(sxx) * sqrt(syy), 0))), 0.0) END AS cosine_similarity,
            CASE WHEN n < 2 THEN 0.0 ELSE sx END AS x_sum, CASE WHEN n < 2 THEN 0.0 ELSE sy END AS y_sum, CASE WHEN n < 2 THEN 0.0 ELSE sxx END AS x_squared_sum,
            CASE WHEN n < 2 THEN 0.0 ELSE syy END AS y_squared_sum, CASE WHEN n < 2 THEN 0.0 ELSE sxy END AS xy_sum, CASE WHEN n < 2 THEN 0.0 ELSE n::DOUBLE END AS n FROM sums""",
    }


def sql(select: str, **more: str) -> str:
    """*select* with the named parts that it needs, each after those it needs itself."""
    parts, done, out = PARTS | more, set(), []

    def need(text: str) -> None:
        for name in parts:
            if name not in done and re.search(rf"\b(FROM|JOIN)\s+\(?\s*{name}\b", text):
                done.add(name)
                need(parts[name])
                out.append(f"{name} AS ({parts[name]})")

    need(select)
    return ("WITH " + ",\n".join(out) + "\n" if out else "") + select
