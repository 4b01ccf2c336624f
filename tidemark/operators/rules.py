"""The rule tables as column expressions: one row an asset, no function sees another row.

Flags that may be missing count as false, except the relative-strength flag, which stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import messages, yes
from tidemark.operators.features import DOWN, UP


def choose(*cases: tuple[Column, object], default: object) -> Column:
    """The value of the first case whose condition is true."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def regime(score: Column) -> Column:
    return choose((score < 25, "STRONG RISK-OFF"), (score < 40, "RISK-OFF"), (score < 60, "NEUTRAL"), (score < 75, "RISK-ON"), default="STRONG RISK-ON")


def funding_regime(score: Column) -> Column:
    return choose((score < 40, "RESTRICTIVE"), (score > 60, "SUPPORTIVE"), default="NEUTRAL")


def agreement(usd: Column, fxn: Column) -> Column:
    return F.when(regime(usd) == regime(fxn), "AGREE").otherwise("DIVERGENT")


def conviction(stale: Column, candidate: Column, agree: Column, funding: Column, market: Column) -> dict[str, Column]:
    """The five parts of the rubric, 0 to 2 each, and their sum as conviction."""
    parts = {
        "money_freshness": choose((~stale, 2), (candidate, 1), default=0),
        "agreement": F.when(agree == "AGREE", 2).otherwise(0),
        "transmission": F.lit(2),
        "funding": choose((funding == "SUPPORTIVE", 2), (funding == "NEUTRAL", 1), default=0),
        "market": market,
    }
    total = sum(parts.values(), F.lit(0))
    return parts | {"conviction": total, "conviction_label": F.concat(total.cast("string"), F.lit("/10"))}


def market_score(positive: Column, known: Column) -> Column:
    """Confirmation by the core markets: 1 as long as fewer than three are known."""
    return choose((known < 3, 1), (positive >= 3, 2), (positive == 2, 1), default=0)


def as_shown(x: Column) -> Column:
    """A rounded number as text, without a zero after the point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


#: Fixed values, here and below: the sentences that decisions, reports and radars state.
AUDIT_DETAIL = (
    "RBA blocker passed, but the exact Aug-15 macro matrix, adjusted-price mirror, original v1.2 exact-ticker runner and full56 baseline bytes were not preserved. "
    "Promotion remains fail-closed."
)


def divergence_detail(c: dict[str, Column]) -> Column:
    return F.format_string("Validated Core: USD %s %s vs FX-neutral %s %s.", as_shown(c["usd_score"]), c["usd_regime"], as_shown(c["fxn_score"]), c["fxn_regime"])


def vintage_detail(c: dict[str, Column]) -> Column:
    return F.format_string("Validated Core is %s; production candidate is %s and is not yet CORE.", c["money_date"], c["candidate_date"])


def decision_reasons(c: dict[str, Column]) -> Column:
    """Five, in order."""
    fixed = lambda x: F.format_number(x, 1)
    newer = F.format_string(
        "Newer production-source Money candidate is USD %s / FX-neutral %s as available %s.", fixed(c["candidate_usd_score"]), fixed(c["candidate_fxn_score"]), c["candidate_date"]
    )
    return F.array(
        F.lit("Validated Money Core is divergent: USD Risk-On, FX-neutral Neutral."),
        F.when(c["candidate_date"].isNotNull(), newer).otherwise("No newer production candidate is available."),
        F.format_string("Freshness overlay is %s: %s/4 blocks accelerated and %s/4 are expanding YoY.", c["tilt"], c["accelerating"].cast("string"), c["expanding"].cast("string")),
        F.format_string("Funding remains %s, limiting conviction.", F.lower(c["funding_regime"])),
        F.format_string("%s/%s primary market turns are currently positive.", c["positive"].cast("string"), F.when(c["known"] == 0, 4).otherwise(c["known"]).cast("string")),
    )


#: What a transmission says of its basis, and eligibility of its reason.
BASES = {"usd": "USD Money", "fxn": "FX-neutral Money"}
CONTEXT_BASIS = "Broad Money context only"
NOTES = {"usd": "Uses USD Money only; no synthetic USD/FX-neutral blend.", "fxn": "Uses FX-neutral Money only; no synthetic blend."}
REASONS = {
    "CORE_CONTEXT_ONLY": "Backtest did not support dislocation as an incremental hard gate; promoted Money signal remains primary.",
    "CORE_HARD_GATE": "Promoted transmission plus asset-specific dislocation.",
    "RESEARCH_DISLOCATION_PRIMARY": "Research-only duration thesis; real-yield dislocation is the primary gate and Money is context only.",
    "RESEARCH_PROXY_HARD_GATE": "Research Money context plus backtest-supported relative dislocation; not promoted Core transmission.",
    "RESEARCH_DATA_INCOMPLETE": "Public credit-spread history is insufficient for the pre-specified 60M backtest gate. No accumulation label allowed.",
    "RESEARCH_CONTEXT_ONLY": "Research-only dislocation/positioning/trend context. It can surface Radar setups but cannot create a promoted strategic signal.",
}
OTHER_REASON = "No comparable backtested strategic dislocation model is available. Money and trend are monitoring context only."
UNAVAILABLE = {"CORE_HARD_GATE": "Required dislocation signal unavailable.", "RESEARCH_PROXY_HARD_GATE": "Required relative dislocation signal unavailable."}


def transmission(money: Column, tier: Column, usd: Column, fxn: Column, tilt: Column) -> dict[str, Column]:
    """Whether money supports the asset: by USD or FX-neutral money where that is its basis, else by the tilt."""
    holds = tilt != "DETERIORATING"
    score = choose((money == "usd", usd), (money == "fxn", fxn), default=F.lit(None).cast("double"))
    core = (tier == "CORE") & money.isin("usd", "fxn")
    return {
        "t_pass": holds & (F.coalesce(score, F.lit(50.0)) >= 50),
        "t_score": F.round(score, 1),
        "t_promoted": core,
        "t_basis": choose(*((money == k, v) for k, v in BASES.items()), default=CONTEXT_BASIS),
        "t_note": choose(*((money == k, v) for k, v in NOTES.items()), default=F.concat(
            F.lit("USD "), F.format_number(usd, 1), F.lit(" / FX-neutral "), F.format_number(fxn, 1), F.lit(" are shown separately; no composite is computed."))),
        "t_turn": tilt,
        "t_tier": F.when(core, "CORE_WITH_RESEARCH_FRESHNESS_GUARDRAIL").otherwise("RESEARCH_MONEY_CONTEXT"),
    }


def strategic(mode: Column, t: Column, d: Column, d_known: Column) -> dict[str, Column]:
    """Eligibility, label, score and cap by strategic mode; t and d are the passes of transmission and
    dislocation, d_known whether there is a dislocation."""
    n = lambda *flags: sum((f.cast("int") for f in flags), F.lit(0)).cast("string")
    both = t & d
    context, hard, primary = mode == "CORE_CONTEXT_ONLY", mode == "CORE_HARD_GATE", mode == "RESEARCH_DISLOCATION_PRIMARY"
    proxy, incomplete, only = mode == "RESEARCH_PROXY_HARD_GATE", mode == "RESEARCH_DATA_INCOMPLETE", mode == "RESEARCH_CONTEXT_ONLY"
    gate = lambda zone, wait, weak, none: choose((~d_known, "DATA INCOMPLETE"), (both, zone), (t, wait), (d, weak), default=none)
    label = choose(
        (context, choose((both, "ELIGIBLE + CHEAPNESS BONUS"), (t, "ELIGIBLE"), default="MONEY NOT SUPPORTIVE")),
        (hard, gate("ACCUMULATION ZONE", "WAIT FOR DISLOCATION", "CHEAP, MONEY NOT CONFIRMED", "NO STRATEGIC EDGE")),
        (primary, F.when(d, "PROVISIONAL STRATEGIC ZONE").otherwise("WAIT FOR YIELD DISLOCATION")),
        (proxy, gate("PROVISIONAL ACCUMULATION ZONE", "WAIT FOR RELATIVE DISLOCATION", "CHEAP, MONEY CONTEXT WEAK", "NO RESEARCH EDGE")),
        (incomplete, "INSUFFICIENT HISTORY"), (only, "WATCH ONLY"), default="NO VALIDATED DISLOCATION MODEL",
    )
    gates = lambda suffix: F.when(~d_known, F.concat(n(t), F.lit("/1 known"))).otherwise(F.concat(n(t, d), F.lit(suffix)))
    score = choose(
        (context, F.concat(n(t), F.lit("/1 core gate"))), (hard, gates("/2")), (primary, F.concat(n(d), F.lit("/1 research gate"))), (proxy, gates("/2 research")),
        (incomplete, F.when(d_known, "research data available").otherwise("data incomplete")), default="context only",
    )
    return {
        "s_label": label,
        "s_eligible": choose((context, t), (hard | proxy, d_known & both), (primary, d), default=F.lit(False)),
        "s_score": score,
        "s_reason": choose(*((~d_known & (mode == k), v) for k, v in UNAVAILABLE.items()), *((mode == k, v) for k, v in REASONS.items()), default=OTHER_REASON),
        "s_cap": choose((context | hard, "NORMAL"), (primary | proxy, "PROVISIONAL"), default="WATCH_ONLY"),
    }


def entry(p_known: Column, p_pass: Column, turn_known: Column, turn_pass: Column) -> dict[str, Column]:
    """Entry quality from positions and turn; what is not known is neither a pass nor counted."""
    known = p_known.cast("int") + turn_known.cast("int")
    passes = (p_known & p_pass).cast("int") + (turn_known & turn_pass).cast("int")
    return {
        "e_label": choose((known == 0, "UNCONFIRMED"), (passes == 2, "HIGH"), (passes == 1, "PARTIAL"), default="LOW"),
        "e_score": F.concat_ws("/", passes.cast("string"), known.cast("string")),
    }


def action(cap: Column, label: Column, eligible: Column, backtest: Column, e: Column) -> Column:
    provisional = (cap == "PROVISIONAL") | (backtest == "INSUFFICIENT_SAMPLE")
    return choose(
        (cap == "WATCH_ONLY", label),
        (~eligible, F.when(F.contains(label, F.lit("WAIT")), "WAIT — DO NOT CHASE").otherwise("WAIT")),
        (provisional, choose((e == "HIGH", "PROVISIONAL SCALE-IN"), (e == "PARTIAL", "PROVISIONAL START SMALL"), default="PROVISIONAL WATCH")),
        (e == "HIGH", "ACCUMULATE"), (e == "PARTIAL", "SCALE IN SMALL"), (e == "LOW", "START SMALL / WAIT FOR BETTER ENTRY"), default="ELIGIBLE, ENTRY UNCONFIRMED",
    )


#: Assets whose research setups are watched.
WATCHED = ("VNQ", "VEA", "IWM", "SLV", "USO", "CPER", "DBA", "FXY")
DURATION = ("TLT", "IEF")


def triggers(c: dict[str, Column]) -> dict[str, Column]:
    """What would raise (at most three) and lower (at most two) an asset's standing, in order. A crowded
    position counts here even where positions are not available."""
    asset, d, turn_pass = c["asset"], c["d_pass"], c["turn_pass"]
    up = messages(
        ((c["strategic_mode"] == "CORE_HARD_GATE") & ~d, "Asset-specific dislocation reaches its pre-specified cheapness threshold while promoted Money remains supportive."),
        ((asset == "GLD") & ~c["s_eligible"], "FX-neutral Money returns to a supportive regime."),
        (asset.isin(*DURATION) & d & ~turn_pass, "Duration price turn becomes positive while real-yield dislocation remains elevated."),
        (asset.isin(*DURATION) & ~d, "Relevant real-yield 60M z-score rises back above +1."),
        ((asset == "EEM") & ~d, "EEM/SPY relative-price dislocation reaches z <= -1 while broad Money context stays supportive."),
        (asset.isin(*WATCHED), "Research dislocation/positioning aligns with an early price and relative-strength turn."),
        (asset == "HYG", "A reproducible long-history credit-spread series becomes available and shows a genuinely wide-spread dislocation."),
        (asset == "BTC", "A robust BTC-specific dislocation model is validated and price turn stabilizes."),
        (c["p_known"] & ~c["p_pass"], "Asset-specific CFTC positioning washes out toward the contrarian <=25th percentile zone."),
        (c["turn_known"] & ~turn_pass, "Completed-month price turn turns positive."),
    )
    core = c["tier"] == "CORE"
    down = messages(
        (core & (c["money"] == "fxn"), "FX-neutral Money deteriorates materially."),
        (core & (c["money"] != "fxn"), "USD Money deteriorates materially."),
        (~core, "Broad Money freshness deteriorates across several major blocks."),
        (c["crowded"], "Positioning remains or becomes crowded while price loses confirmation."),
        (c["turn_known"] & turn_pass, "Completed-month price turn rolls over."),
    )
    return {"upgrade": F.slice(up, 1, 3), "downgrade": F.slice(down, 1, 2)}


def report_bucket(act: Column) -> Column:
    return choose(
        (act.rlike("ACCUMULATE|SCALE-IN|SCALE IN SMALL"), "accumulate"), (F.contains(act, F.lit("DO NOT CHASE")), "dont_chase"),
        (act.rlike("INSUFFICIENT|NO VALIDATED"), "limited"), default="watch",
    )


def short_dislocation(mode: Column, known: Column, z: Column) -> Column:
    """Stretched on the other side, by the rounded z; levels are stretched when low."""
    level = mode.isin("RESEARCH_DISLOCATION_PRIMARY", "RESEARCH_DATA_INCOMPLETE")
    return yes(known & F.when(level, z <= -1).otherwise(z >= 1))


def asymmetry(macro: Column, contrarian: Column, turn: Column, strength: Column, adverse: Column) -> dict[str, Column]:
    """label and evidence of one side; strength may be null, which is no evidence either way."""
    parts = F.filter(F.array(macro, contrarian, turn, strength), lambda x: x.isNotNull())
    passes, core, opposed = F.size(F.filter(parts, lambda x: x)), macro & contrarian & turn, yes(~strength)
    return {
        "label": choose((core & ~adverse & ~opposed, "HIGH"), (core | (passes >= 2), "MEDIUM"), default="LOW"),
        "evidence": F.concat_ws("/", passes.cast("string"), F.size(parts).cast("string")),
        "capped": adverse | opposed,
    }


def phase(macro_long: Column, macro_short: Column, long: Column, short: Column, trend: Column) -> Column:
    """Where an asset stands in its cycle; long and short are the contrarian cases."""
    up, down = macro_long & long, macro_short & short
    return choose(
        (up & (trend == "EARLY_UP"), "EARLY_LONG"), (down & (trend == "EARLY_DOWN"), "EARLY_SHORT"),
        (up & (trend == "CONFIRMED_UP"), "CONFIRMED_LONG"), (down & (trend == "CONFIRMED_DOWN"), "CONFIRMED_SHORT"),
        (up & trend.isin("MIXED", *DOWN), "SETUP_LONG"), (down & trend.isin("MIXED", *UP), "SETUP_SHORT"),
        ((trend == "CONFIRMED_UP") & short, "MATURE_LONG_DONT_CHASE"), ((trend == "CONFIRMED_DOWN") & long, "MATURE_SHORT_DONT_CHASE"),
        (trend == "CONFIRMED_UP", "TREND_UP_NO_CONTRARIAN_EDGE"), (trend == "CONFIRMED_DOWN", "TREND_DOWN_NO_CONTRARIAN_EDGE"), default="WATCH",
    )


def side(long: Column, short: Column, long_label: Column, short_label: Column) -> Column:
    """LONG or SHORT if only one is eligible, or if only one of both is HIGH."""
    return choose(
        (long & ~short, "LONG"), (short & ~long, "SHORT"), (~long, "NONE"),
        ((long_label == "HIGH") & (short_label != "HIGH"), "LONG"), ((short_label == "HIGH") & (long_label != "HIGH"), "SHORT"), default="NONE",
    )


def rank(best: Column, where: Column) -> Column:
    by_phase = choose((where.startswith("EARLY_"), 4), (where.startswith("SETUP_"), 3), (where.startswith("CONFIRMED_"), 2), default=0)
    return choose((best == "HIGH", 3), (best == "MEDIUM", 2), default=1) * 10 + by_phase


def radar_conflicts(c: dict[str, Column]) -> Column:
    long, short = c["long_eligible"], c["short_eligible"]
    return messages(
        (long & c["expensive"], "Long contrarian evidence conflicts with an expensive/stretched price dislocation."),
        (long & c["crowded"], "Long case conflicts with crowded positioning."),
        (long & ~c["rs_long"], "Long case conflicts with weakening relative strength versus SPY."),
        (short & c["cheap"], "Short case conflicts with a cheap long-side dislocation."),
        (short & c["washed"], "Short case conflicts with washed-out positioning."),
        (short & ~c["rs_short"], "Short case conflicts with improving relative strength versus SPY."),
    )


def radar_reasons(c: dict[str, Column]) -> Column:
    """At most five."""
    found = messages(
        (c["macro_long"], "Money/transmission context supports the long side."),
        (c["macro_short"], "Money/transmission context is not supportive and can support the short side."),
        (c["cheap"], "Contrarian long dislocation threshold is met."),
        (c["expensive"], "Opposite-side dislocation is stretched enough to support a contrarian short watch."),
        (c["washed"], "CFTC positioning is in the contrarian-friendly lower quartile."),
        (c["crowded"], "CFTC positioning is crowded in the upper quartile."),
        (c["trend"] == "EARLY_UP", "Price is in an early upside turn rather than a mature confirmed trend."),
        (c["trend"] == "EARLY_DOWN", "Price is in an early downside turn rather than a mature confirmed trend."),
        (c["rs_long"], "Relative strength versus SPY is improving."),
        (c["rs_short"], "Relative strength versus SPY is weakening."),
    )
    return F.slice(found, 1, 5)
