"""Shared SQL building blocks for the independent checks.

Each block is plain SQL over the given tables; ``with_blocks`` prepends the blocks a
statement names, in dependency order.
"""

from __future__ import annotations

from ..functions.keyed import hash_sql, noise_sql
from ..sources.frame import LATE_YEAR, MODELS, STAND_INS

KEY = "row_id"
SEEDS = (42, 2026, 7)


def _clip(x: str, lo: float = 0.0, hi: float = 100.0) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def bin_edges(source: str, value: str, bins: int, where: str = "TRUE") -> str:
    """A list of inner quantile edges, duplicates dropped."""
    probs = ", ".join(f"{i}.0/{bins}" for i in range(bins + 1))
    return (
        f"SELECT list_filter(list_distinct(e), lambda x: x > e[1] AND x < e[{bins + 1}]) AS edges FROM ("
        f"SELECT list_transform(quantile_cont({value}, [{probs}]), lambda x: round(x, 6)) AS e "
        f"FROM {source} WHERE {where})"
    )


def bin_number(value: str, edges: str = "edges") -> str:
    return f"CAST(len(list_filter({edges}, lambda x: x < {value})) AS INTEGER)"


def fold_sql(source: str, strata: str = "bin", seeds=SEEDS, n_folds: int = 5) -> str:
    arms = " UNION ALL ".join(
        f"SELECT row_id, {strata} AS stratum, {r} AS repeat, {hash_sql('row_id', s)} AS h FROM {source}"
        for r, s in enumerate(seeds)
    )
    return (
        f"SELECT row_id, repeat, CAST((row_number() OVER (PARTITION BY repeat, stratum ORDER BY h, row_id) - 1) "
        f"% {n_folds} AS INTEGER) AS fold FROM ({arms})"
    )


def _frame() -> str:
    return f"""
SELECT o_orderkey AS row_id,
  CASE WHEN {hash_sql('o_orderkey', 5)} % 10 < (CASE WHEN year(o_orderdate) >= {LATE_YEAR} THEN 3 ELSE 7 END)
       THEN 'train' ELSE 'test' END AS split,
  CAST(year(o_orderdate) AS INTEGER) AS cohort_year, ship_year,
  o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment,
  CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS acctbal,
  n_lines, avg_qty, sum_qty, n_ret, ret_qty, ext_price, disc_pts, tax_pts,
  round(least(o_totalprice / 4600.0, 100.0), 2) AS score,
  round({_clip(f"40.0 + 6.0 * coalesce(n_lines, 0.0) + 0.3 * coalesce(avg_qty, 0.0) + 10.0 * {noise_sql('o_orderkey', 77)}")}, 2) AS y2
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, round(avg(l_quantity), 4) AS avg_qty,
    round(sum(l_quantity), 2) AS sum_qty,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS n_ret,
    round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS ret_qty,
    round(sum(l_extendedprice), 2) AS ext_price,
    round(avg(l_discount) * 1000.0, 3) AS disc_pts, round(avg(l_tax) * 1000.0, 3) AS tax_pts,
    CAST(min(year(l_shipdate)) AS INTEGER) AS ship_year
  FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""


def _preds() -> str:
    cols = ",\n  ".join(
        f"round({_clip(f'CAST({a} AS DOUBLE) * score + {b} + {w} * {noise_sql(KEY, s)}')}, 4) AS {m}"
        for m, (a, b, w, s) in STAND_INS.items()
    )
    cap = _clip(f"(score - 90.0) / 12.0 + 0.25 * {noise_sql('row_id', 16)}", 0.0, 1.0)
    return (
        f"SELECT row_id, split, cohort_year, segment, status, score, {cols}, round({cap}, 6) AS p_cap FROM frame"
    )


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "frame": ((), _frame()),
    "train": (("frame",), "SELECT * FROM frame WHERE split = 'train'"),
    "test": (("frame",), "SELECT * FROM frame WHERE split = 'test'"),
    "strat_edges": (("train",), bin_edges("train", "score", 9, "score < 100")),
    "strata": (
        ("train", "strat_edges"),
        f"SELECT row_id, score, CASE WHEN score >= 100 THEN 9 ELSE {bin_number('score')} END AS bin "
        "FROM train, strat_edges",
    ),
    "folds": (("strata",), fold_sql("strata")),
    "preds": (("frame",), _preds()),
    "ptrain": (("preds",), "SELECT * FROM preds WHERE split = 'train'"),
    "preds_long": (
        ("preds",),
        " UNION ALL ".join(f"SELECT '{m}' AS model, split, row_id, {m} AS pred FROM preds" for m in MODELS),
    ),
    "weights": (
        ("train", "test"),
        """
SELECT row_id, cohort_year, w / avg(w) OVER () AS w FROM (
  SELECT row_id, t.cohort_year, coalesce(pe, 0.0) / pt AS w FROM train t
  JOIN (SELECT cohort_year, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM train) AS pt FROM train GROUP BY 1) a
    ON a.cohort_year = t.cohort_year
  LEFT JOIN (SELECT cohort_year, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM test) AS pe FROM test GROUP BY 1) b
    ON b.cohort_year = t.cohort_year)""",
    ),
    "scored": (
        ("ptrain", "weights"),
        "SELECT p.*, w FROM ptrain p JOIN weights USING (row_id)",
    ),
    "texts": (
        (),
        f"SELECT doc_id AS row_id, CASE WHEN {hash_sql('doc_id', 5)} % 10 < 7 THEN 'train' ELSE 'test' END AS split, "
        "text, lang, source, round(least(n_chars / 20.0, 100.0), 2) AS score FROM documents",
    ),
}


def with_blocks(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH ...`` text: the named blocks (and what they need), then ``extra``, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in BLOCKS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({BLOCKS[n][1]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} {body}" if parts else body)
