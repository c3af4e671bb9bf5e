"""The explainable linear score and what follows from it: probability, admission, keep value, level, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.identity import clip01, col

#: Weights of the features.
WEIGHTS = {
    "lexical": 0.24,
    "execution": 0.26,
    "structural": 0.14,
    "co_access": 0.12,
    "recency": 0.08,
    "diagnostic": 0.22,
    "token_cost": -0.08,
    "staleness": -0.30,
    "semantic": 0.16,
}
#: Budgets and thresholds.
TOKEN_BUDGET, ADMISSION, DECAY, NEIGHBOURS, PREFETCH = 2400, 0.28, 0.92, 8, 0.62


def recency(turn, last, rate: float = 0.35) -> Column:
    """exp(-rate * turns since the last access); 0 if there was none (last is 0)."""
    t, x = col(turn), F.coalesce(col(last), F.lit(0))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.exp(-F.lit(rate) * F.greatest(F.lit(0), t - x)))


def features(c: dict[str, Column], sources: Column, turn: Column, budget: int = TOKEN_BUDGET) -> dict[str, Column]:
    """The nine features from working-set columns and candidate sources.

    c: lexical_weight, overlap, execution_score, co_access_score, last_access_turn, access_frequency, edit_likelihood,
    token_count, staleness, stale, kind, and semantic (null where there is no vector index).
    """
    zero = lambda k: F.coalesce(c[k].cast("double"), F.lit(0.0))
    has = lambda s: F.array_contains(sources, s)
    lexical = clip01(clip01(zero("lexical_weight") / 2.5) + 0.5 * zero("overlap"))
    structural = F.when(has("callee") & has("caller"), 1.0).when(has("callee") | has("caller"), 0.8).otherwise(0.1)
    co = clip01(zero("co_access_score"))
    co = F.when(has("co_access"), F.greatest(co, F.lit(0.6))).otherwise(co)
    diagnostic = clip01(zero("edit_likelihood"))
    diagnostic = F.when(has("diagnostic"), F.greatest(diagnostic, F.lit(0.9))).otherwise(diagnostic)
    cost = clip01(zero("token_count") / max(budget, 1))
    return {
        "lexical": F.when(has("symbol"), F.greatest(lexical, F.lit(0.75))).otherwise(lexical),
        "execution": clip01(zero("execution_score")),
        "structural": F.when(has("prefetch_edge"), F.greatest(structural, F.lit(0.85))).otherwise(structural),
        "co_access": F.when(has("co_access_history"), F.greatest(co, F.lit(0.4))).otherwise(co),
        "recency": clip01(0.6 * recency(turn, c["last_access_turn"]) + 0.4 * clip01(zero("access_frequency") / 6.0)),
        "diagnostic": F.when(has("diff"), F.greatest(diagnostic, F.lit(0.6))).otherwise(diagnostic),
        "token_cost": F.when(c["kind"] == "module", F.least(F.lit(1.0), cost + 0.3)).otherwise(cost),
        "staleness": F.when(F.coalesce(c["stale"].cast("boolean"), F.lit(False)), 1.0).otherwise(clip01(zero("staleness"))),
        "semantic": clip01(zero("semantic")),
    }


def score(f: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of features, in the order of the weights."""
    w = WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for k, v in w.items():
        if k in f:
            total = total + F.lit(v) * f[k]
    return total


def p_used_soon(s) -> Column:
    return 1 / (1 + F.exp(-6.0 * (col(s) - 0.30)))


def expected_value(p, tokens, budget: int = TOKEN_BUDGET, file_tokens: Column | None = None) -> dict[str, Column]:
    """Value of admitting a region: the calls it saves, less its tokens and the harm of displacing others."""
    p, t = col(p), col(tokens).cast("double")
    whole = file_tokens if file_tokens is not None else F.greatest(t * 3, t + 400)
    miss, admit = 600 + F.least(whole, F.lit(6000.0)), t + 30
    pollution = 400 * (1 - p) * (t / max(budget, 1))
    return {"ev": p * miss - admit - pollution, "miss_cost": miss, "admit_cost": admit, "pollution": pollution}


def admission(s, stale, execution, diagnostic, ev, least: float = ADMISSION) -> Column:
    """Verdict: admit, or why not (stale, score, value)."""
    return (
        F.when(col(stale) >= 1.0, "stale")
        .when((col(s) < least) & (col(execution) < 0.5) & (col(diagnostic) < 0.8), "score")
        .when(col(ev) <= 0, "value")
        .otherwise("admit")
    )


def admission_text(verdict, s, ev, p, admit_cost, least: float = ADMISSION) -> Column:
    v = col(verdict)
    return (
        F.when(v == "stale", "stale")
        .when(v == "score", F.format_string(f"score %.2f < threshold {least:.2f}", col(s)))
        .when(v == "value", F.format_string("EV %.0f ≤ 0 (p=%.2f, admit=%.0f)", col(ev), col(p), col(admit_cost)))
        .otherwise(F.format_string("EV +%.0f (p=%.2f)", col(ev), col(p)))
    )


def keep_value(pinned, frequency, last, turn, execution, intent, agent, co, tokens) -> Column:
    """Frequency x recency x utility per token; pinned regions stay above all."""
    x = F.coalesce(col(last), F.lit(0))
    fresh = F.when(x == 0, F.lit(0.35)).otherwise(F.exp(-0.25 * F.greatest(F.lit(0), col(turn) - x)))
    utility = 0.15 + 0.4 * col(execution) + 0.3 * col(intent) + 0.2 * col(agent) + 0.1 * col(co)
    cost = F.greatest(F.coalesce(col(tokens), F.lit(1)).cast("double"), F.lit(1.0))
    return F.when(col(pinned).cast("boolean"), F.lit(1e9)).otherwise((col(frequency) + 0.1) * fresh * utility / cost * 100)


def representation(s, tokens, pinned) -> Column:
    x = col(s)
    return (
        F.when(col(pinned).cast("boolean") | (x >= 0.55), "exact")
        .when((x >= 0.42) & (col(tokens) < 120), "exact")
        .when(x >= 0.30, "signature")
        .otherwise("summary")
    )


def memory_level(present, stale, pinned, admitted, in_bundle, in_frames, elsewhere) -> Column:
    """L0 pinned or in a failing frame, L1 served, L2 known, backing else; stale regions keep their slot."""
    t = lambda c: F.coalesce(col(c).cast("boolean"), F.lit(False))
    return (
        F.when(t(stale), F.when(t(in_bundle), "L1").when(t(pinned), "L0").when(t(present), "L2").otherwise("backing"))
        .when(t(pinned) | t(in_frames), "L0")
        .when(t(admitted) | t(in_bundle), "L1")
        .when(t(present) | t(elsewhere), "L2")
        .otherwise("backing")
    )


def prefetch_blend(raw, parent) -> Column:
    return F.greatest(col(raw), 0.72 * col(parent) + 0.20 * col(raw))


def why(f: dict[str, Column], sources: Column, agent: Column, edit: Column) -> Column:
    """Reasons in a fixed order; of some pairs only the stronger one."""
    has = lambda s: F.array_contains(sources, s)
    bits = [
        F.when(f["execution"] >= 0.9, "executed only by the failing test").when(f["execution"] > 0.4, "executed by targeted test"),
        F.when(has("diagnostic"), "in failing-test traceback").when(edit >= 0.85, "edited this session"),
        F.when(has("symbol"), "exact symbol match").when(f["lexical"] > 0.45, "intent/lexical match"),
        F.when(has("callee"), "call successor of active region"),
        F.when(has("caller"), "caller of active region"),
        F.when(has("co_access") | (f["co_access"] > 0.5), "co-accessed this session"),
        F.when(has("co_access_history"), "co-accessed in prior tasks"),
        F.when(has("diff"), "changed in working tree"),
        F.when((f["recency"] > 0.5) & (agent > 0), "read this session"),
        F.when(has("prefetch_edge"), "prefetched call edge"),
        F.when(f["staleness"] > 0.5, "STALE — content hash mismatch"),
    ]
    text = F.array_join(F.array_compact(F.array(*bits)), "; ")
    return F.when(text == "", "weak union candidate").otherwise(text)
