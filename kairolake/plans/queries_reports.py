"""Registered queries: reports that put the results of several jobs together (Q14 to Q16), with their SQL."""

from __future__ import annotations

from ..functions.shared import stored
from ..operators import stats as A
from . import queries_jobs as JQ
from . import queries_stats as SQ
from . import reports as P
from .queries_series import R6
from .queries_stats import boot_sql

#: section: (query, keys, metrics)
SECTIONS = {
    "summary": ("a11_method_summary", ["method"], ["n", "acc"]),
    "buckets": ("a12_bucket_table", ["bucket", "method"], ["n_items", "n_paired", "acc", "delta"]),
    "significance": ("a13_bucket_significance", ["bucket"], ["n", "mean", "low", "high", "p", "significant"]),
    "seeds": ("q16_multi_seed", ["method"], ["n", "mean", "std", "low", "high"]),
    "deltas": ("q16_paired_deltas", ["method"], ["n", "mean", "low", "high", "p"]),
    "budget": ("a16_budget_curve", ["budget", "method"], ["n", "mean", "std", "delta"]),
    "coverage": ("a17_coverage_sensitivity", ["method"], ["before", "after"]),
    "prior": ("a18_prior_report", ["method"], ["acc", "prior_acc", "sampling_acc", "delta"]),
    "faithfulness": ("a36_faithfulness", [], ["acc", "deleted_acc", "changed"]),
}
KNOWN = SQ.QUERIES | JQ.QUERIES
REFERENCE = "uniform"


def _report(s, d):
    return P.long_report({name: (KNOWN[query][0](s, d), keys, metrics) for name, (query, keys, metrics) in SECTIONS.items()})


def _report_sql() -> str:
    tables = ", ".join(f"{name}_ as ({KNOWN[query][1]})" for name, (query, _, _) in SECTIONS.items())
    number = lambda m: f"cast({m} as int)::double" if m == "significant" else f'"{m}"::double'
    item = lambda keys: f"concat_ws('|', {', '.join(f'cast({k} as varchar)' for k in keys)})" if keys else "''"
    rows = [f"select '{name}' as section, {item(keys)} as item, '{m}' as metric, {number(m)} as value from {name}_" for name, (_, keys, metrics) in SECTIONS.items() for m in metrics]
    return f"with {tables} {' union all '.join(rows)}"


def _answer_gains(s, d):
    """Bootstrap of each method's gain over uniform frames; the answers are written once, as four parts read them."""
    answers = stored(JQ._answers(s, d).withColumnRenamed("clip_id", "item_id"), "answers")
    return SQ._boot(A.bootstrap(P.gain_over(answers, REFERENCE), ["method"], "item_id", "gain"), ["method"])


ANSWERS = JQ.QUERIES["q15_answers_by_method"][1].rsplit(" select method, count(*)", 1)[0]
CAUSES = SQ.QUERIES["a31_root_causes"][1]
TESTED = f"with {SQ.RESULTS}, {SQ.SEEDS}, {SQ.DELTAS}, {SQ.t_sql('dd', 'config', 'd')} select config, delta, p from tt"

QUERIES = {
    "q14_decisions": (
        lambda s, d: P.decisions(A.root_causes(SQ._facts(s, d)), SQ._deltas(s, d), 0.001, 0.5).withColumns({c: R6(c) for c in ("delta", "p")}),
        f"""select config, coalesce(delta >= 0.001 and p < 0.5, false) as promote, round(delta, 6) as delta, round(p, 6) as p, case when reasons = '' then 0 else cast(len(string_split(reasons, ',')) as int) end as causes, nullif(split_part(reasons, ',', 1), '') as first
        from ({CAUSES}) c left join ({TESTED}) t using (config)""",
    ),
    "q15_answer_gains": (
        _answer_gains,
        f"{ANSWERS}, gg as (select a.method, a.clip_id, (a.correct - b.correct)::double as gain from h a join h b on b.clip_id = a.clip_id and b.method = '{REFERENCE}' where a.method <> '{REFERENCE}'), {boot_sql('gg', 'method', 'clip_id', 'gain')} select method, n, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, round(p, 6) as p from bo",
    ),
    "q16_report": (_report, _report_sql()),
}
