"""From panels to one row per asset: opportunity, decision, radar and report.

Feature frames have a row for each asset of the universe, a table of fixed size, so joining them costs nothing
beside the panels' one shuffle by asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import yes
from tidemark.operators import features, rules
from tidemark.operators.features import DOWN, UP
from tidemark.plans.dims import STATE

#: The level series behind the dislocation models that read one.
LEVELS = {"real_yield_10y_high": "real10", "real_yield_5y_high": "real5", "hy_oas_high": "hyoas"}


#: The numbers of a turn that documents carry.
TREND = ("price", "ma10", "ma10_slope_3m_pct", "return_3m_pct", "return_6m_pct")


def dislocations(prices: DataFrame, cpi: DataFrame, levels: DataFrame, assets: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """The dislocation of each asset by its own model: asset, d_known, d_pass, z60m, d_as_of. An asset whose
    input is missing has none."""
    of = lambda kind: assets.where(F.col("dislocation") == kind).select("asset")
    mine = lambda panel, kind: panel.join(F.broadcast(of(kind)), "asset", "left_semi")
    # an asset has one model, so the panels of all price models share one window
    panel = mine(prices, "absolute").select("asset", "month", "value")
    panel = panel.unionByName(mine(features.real_panel(prices, cpi), "real")).unionByName(mine(features.relative_panel(prices, benchmark), "relative_spy"))
    series = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    chosen = assets.select("asset", series[F.col("dislocation")].alias("series")).where("series is not null")
    as_of = prices.groupBy("asset").agg(F.max("month").alias("as_of")).join(F.broadcast(chosen), "asset")
    out = features.dislocation(features.level_panel(levels, as_of), log=False, high=True)
    out = out.unionByName(features.dislocation(panel))
    return out.select("asset", F.col("available").alias("d_known"), F.col("pass").alias("d_pass"), "z60m", F.col("as_of").alias("d_as_of"))


def opportunity(assets: DataFrame, prices: DataFrame, cpi: DataFrame, levels: DataFrame, positions: DataFrame, tilt: DataFrame, state: dict = STATE) -> DataFrame:
    """One row per asset of the universe: gates, labels, action and triggers.

    positions: asset, available, pass, crowded, percentile_3y, as_of if known (for all assets). tilt: one row with the summary's
    tilt. Missing factors never count as passes."""
    turns = features.turn(prices).select("asset", F.col("available").alias("turn_known"), F.col("pass").alias("turn_pass"), "stage", F.col("as_of").alias("price_as_of"), *TREND)
    held = positions.select("asset", F.col("available").alias("p_known"), F.col("pass").alias("p_pass"), "crowded", "percentile_3y", (F.col("as_of") if "as_of" in positions.columns else F.lit(None).cast("string")).alias("positions_as_of"))
    rows = assets.join(turns, "asset", "left").join(dislocations(prices, cpi, levels, assets), "asset", "left").join(held, "asset", "left")
    rows = rows.withColumns({c: yes(F.col(c)) for c in ("turn_known", "turn_pass", "d_known", "d_pass", "p_known", "p_pass", "crowded")})
    rows = rows.crossJoin(F.broadcast(tilt.select("tilt")))  # one row
    rows = rows.withColumns(rules.transmission(F.col("money"), F.col("tier"), F.lit(state["usd_score"]), F.lit(state["fxn_score"]), F.col("tilt")))
    rows = rows.withColumns(rules.strategic(F.col("strategic_mode"), F.col("t_pass"), F.col("d_pass"), F.col("d_known")))
    rows = rows.withColumns(rules.entry(F.col("p_known"), F.col("p_pass"), F.col("turn_known"), F.col("turn_pass")))
    rows = rows.withColumn("action", rules.action(F.col("s_cap"), F.col("s_label"), F.col("s_eligible"), F.col("backtest"), F.col("e_label")))
    rows = rows.withColumns(rules.triggers({c: F.col(c) for c in rows.columns}))
    research = F.when(F.col("tier") == "CORE", "RESEARCH_DECISION_OVERLAY_WITH_CORE_TRANSMISSION").otherwise("RESEARCH_ONLY")
    return rows.withColumn("evidence_tier", research)


#: What every decision says of the regime.
REGIME = {
    "regime_label": "NEUTRAL", "regime_tilt": "MILD_POSITIVE", "regime_score_status": "NOT_COMPUTED", "regime_provisional": True,
    "regime_basis": "VALIDATED_MONEY_CORE_FIRST_WITH_CURRENT_RESEARCH_CONFIRMATION",
}
#: The markets that confirm a decision.
CORE_MARKETS = ("SPY", "QQQ", "GLD", "DBC")


def decision(turns: DataFrame, nowcast: DataFrame, state: dict = STATE, only_known: bool = True) -> DataFrame:
    """One row: regimes, agreement, the rubric's parts and conviction. turns: asset, turn_known, turn_pass. A
    report counts only markets with a known turn; a decision on its own counts every one it has a row for."""
    core = turns.where(F.col("asset").isin(*CORE_MARKETS))
    core = core.where("turn_known") if only_known else core
    markets = core.agg(F.count_if("turn_pass").alias("positive"), F.count(F.lit(1)).alias("known"))
    usd, fxn = F.lit(state["usd_score"]), F.lit(state["fxn_score"])
    funding = rules.funding_regime(F.lit(state["funding_score"]))
    one = markets.crossJoin(F.broadcast(nowcast)).select(  # one row each
        "positive", "known", "tilt", "coverage", "accelerating", "expanding", rules.regime(usd).alias("usd_regime"), rules.regime(fxn).alias("fxn_regime"),
        rules.agreement(usd, fxn).alias("money_agreement"), funding.alias("funding_regime"), *(F.lit(v).alias(k) for k, v in REGIME.items()),
        F.lit(None).cast("double").alias("regime_score"), F.round(usd, 1).alias("usd_score"), F.round(fxn, 1).alias("fxn_score"), F.lit(state["money_date"]).alias("money_date"),
        F.lit(state["freshness"]).alias("money_freshness"), F.round(F.lit(state["funding_score"]), 1).alias("funding_score"), F.lit(state["funding_date"]).alias("funding_date"),
        *_candidate(state), F.lit(state["promotion_gate"]).alias("promotion_gate"), F.lit(False).alias("core_replacement_allowed"),
    )
    stale, candidate = F.lit(state["freshness"] == "STALE"), F.lit(state["candidate_date"] is not None)
    parts = rules.conviction(stale, candidate, F.col("money_agreement"), F.col("funding_regime"), rules.market_score(F.col("positive"), F.col("known")))
    one = one.withColumns({k if k.startswith("conviction") else f"score_{k}": v for k, v in parts.items()})
    return one.withColumn("key_reasons", rules.decision_reasons({c: F.col(c) for c in one.columns}))


def _candidate(state: dict) -> list[Column]:
    """The newer money vintage, null where there is none."""
    there = state["candidate_date"] is not None
    usd, fxn = (F.lit(state[k] if there else None).cast("double") for k in ("candidate_usd", "candidate_fxn"))
    of = {"candidate_date": F.lit(state["candidate_date"]).cast("string"), "candidate_usd_score": F.round(usd, 1), "candidate_fxn_score": F.round(fxn, 1)}
    of |= {"candidate_usd_regime": F.when(usd.isNotNull(), rules.regime(usd)), "candidate_fxn_regime": F.when(fxn.isNotNull(), rules.regime(fxn))}
    return [v.alias(k) for k, v in of.items()]


def report_conflicts(decided: DataFrame, positioning_error: Column) -> DataFrame:
    """(ordinal, type, detail): the conflicts that a report states of a decision, in order."""
    kind = lambda name, detail: F.struct(F.lit(name).alias("type"), detail.alias("detail"))
    c = {name: F.col(name) for name in decided.columns}
    kinds = F.array(
        kind("MONEY_DIVERGENCE", rules.divergence_detail(c)),
        F.when(F.col("candidate_date").isNotNull(), kind("CORE_VINTAGE_LAG", rules.vintage_detail(c))),
        F.when(F.col("promotion_gate") == "BLOCKED_MISSING_FROZEN_INPUT_BYTES", kind("CORE_PROMOTION_AUDIT", F.lit(rules.AUDIT_DETAIL))),
        F.when(positioning_error.isNotNull(), kind("POSITIONING_SOURCE", positioning_error)),
    )
    found = decided.select(F.posexplode(F.array_compact(kinds)).alias("ordinal", "x"))
    return found.select("ordinal", "x.type", "x.detail")


def report(found: DataFrame) -> DataFrame:
    """(bucket, asset, asset_class, evidence_tier, s_label, e_label, action) of an opportunity."""
    return found.select(rules.report_bucket(F.col("action")).alias("bucket"), "ordinal", "asset", "asset_class", "evidence_tier", "s_label", "e_label", "action")


def radar(found: DataFrame, prices: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """An opportunity with the radar's flags, phase, side, asymmetry, conflicts, reasons and rank."""
    relative = features.turn(features.relative_panel(prices, benchmark)).where("available").select("asset", F.col("stage").alias("rs_stage"))
    c = F.col
    rows = found.join(relative, "asset", "left").withColumns(
        {
            "trend": F.coalesce("stage", F.lit("MIXED")),
            "macro_long": c("t_pass"),
            "macro_short": ~c("t_pass"),
            "cheap": c("d_pass"),
            "expensive": rules.short_dislocation(c("strategic_mode"), c("d_known"), c("z60m")),
            "washed": c("p_known") & c("p_pass"),
            "crowded": c("p_known") & c("crowded"),
            "rs_long": c("rs_stage").isin(*UP),
            "rs_short": c("rs_stage").isin(*DOWN),
        }
    )
    rows = rows.withColumns({"long_contrarian": c("cheap") | c("washed"), "short_contrarian": c("expensive") | c("crowded"), "turn_long": c("trend").isin(*UP), "turn_short": c("trend").isin(*DOWN)})
    long = rules.asymmetry(c("macro_long"), c("long_contrarian"), c("turn_long"), c("rs_long"), c("short_contrarian"))
    short = rules.asymmetry(c("macro_short"), c("short_contrarian"), c("turn_short"), c("rs_short"), c("long_contrarian"))
    rows = rows.withColumns({f"long_{k}": v for k, v in long.items()} | {f"short_{k}": v for k, v in short.items()})
    rows = rows.withColumns(
        {
            "phase": rules.phase(c("macro_long"), c("macro_short"), c("long_contrarian"), c("short_contrarian"), c("trend")),
            "long_eligible": c("macro_long") & c("long_contrarian"),
            "short_eligible": c("macro_short") & c("short_contrarian"),
        }
    )
    rows = rows.withColumn("preferred_side", rules.side(c("long_eligible"), c("short_eligible"), c("long_label"), c("short_label")))
    best = rules.choose((c("preferred_side") == "LONG", c("long_label")), (c("preferred_side") == "SHORT", c("short_label")), default="LOW")
    rows = rows.withColumn("best_asymmetry", best)
    flags = {name: c(name) for name in rows.columns}
    rows = rows.withColumns({"conflicts": rules.radar_conflicts(flags), "reasons": rules.radar_reasons(flags), "rank": rules.rank(c("best_asymmetry"), c("phase"))})
    return rows.withColumns({"core_transmission": c("tier") == "CORE", "invalidation": c("downgrade")})


def radar_document(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(asset, document): a radar's row as an endpoint sends it, grouped by subject, with the decision's regime."""
    of = lambda *names: F.struct(*names)
    regime = F.struct(F.col("regime_label").alias("label"), F.col("regime_tilt").alias("tilt"), F.col("conviction_label").alias("conviction"), F.col("funding_regime").alias("funding"))
    one = rows.crossJoin(F.broadcast(decided.select(regime.alias("regime_context"), F.col("money_date"))))  # one row
    return as_json(
        one.select(
            "asset", "asset_class", "core_transmission", "phase", "preferred_side", "best_asymmetry", "regime_context",
            of(F.col("long_label").alias("label"), F.col("long_evidence").alias("evidence")).alias("long_asymmetry"), of(F.col("short_label").alias("label"), F.col("short_evidence").alias("evidence")).alias("short_asymmetry"),
            of(F.col("macro_long").alias("long_support"), F.col("macro_short").alias("short_support"), F.col("money").alias("basis"), F.col("t_score").alias("score"), F.col("t_turn").alias("freshness_turn")).alias("macro"),
            of(F.col("cheap").alias("cheap_long"), F.col("expensive").alias("expensive_short"), F.col("washed").alias("positioning_washed"), F.col("crowded").alias("positioning_crowded"),
                F.col("z60m").alias("dislocation_z"), F.col("percentile_3y").alias("positioning_percentile")).alias("contrarian"),
            of(F.col("trend").alias("stage"), *TREND, F.col("rs_stage").alias("relative_strength")).alias("trend"),
            "conflicts", F.col("reasons").alias("mechanical_reasons"), "invalidation", of(F.col("price_as_of").alias("price"), F.col("positions_as_of").alias("positioning"), F.col("money_date").alias("money")).alias("freshness"),
        ), "asset",
    )




#: What every opportunity says of its back-test.
BACKTEST_NOTE = "Backtest guides overlay design only; it does not alter frozen Money Core."


def opportunity_document(rows: DataFrame, errors: DataFrame | None = None, state: dict = STATE) -> DataFrame:
    """(asset, document): a row of opportunity() as an endpoint sends it: eligibility with its reason and inputs, entry quality
    with its inputs, action, triggers, and the error of refused inputs (asset, error), if any are given."""
    of, c = F.struct, F.col
    named = lambda **columns: F.struct(*(v.alias(k) for k, v in columns.items()))
    failed = rows.withColumn("error", F.lit(None).cast("string")) if errors is None else rows.join(errors.select("asset", "error"), "asset", "left")
    transmission = named(**{"pass": c("t_pass")}, score=c("t_score"), money_basis=c("t_basis"), core_date=F.lit(state["money_date"]), core_freshness=F.lit(state["freshness"]), freshness_turn=c("t_turn"),
                         evidence_tier=c("t_tier"), promoted_transmission=c("t_promoted"), note=c("t_note"))
    dislocation = named(available=c("d_known"), **{"pass": c("d_pass")}, z60m=c("z60m"), as_of=c("d_as_of"))
    positioning = named(available=c("p_known"), **{"pass": c("p_pass")}, crowded=c("crowded"), percentile_3y=c("percentile_3y"), as_of=c("positions_as_of"))
    turn = of(c("turn_known").alias("available"), c("turn_pass").alias("pass"), "stage", *TREND)
    return as_json(
        failed.select(
            "asset", "asset_class", "evidence_tier", named(status=c("backtest"), episode_starts=c("episodes"), note=F.lit(BACKTEST_NOTE)).alias("backtest"),
            named(score=c("s_score"), eligible=c("s_eligible"), label=c("s_label"), reason=c("s_reason"), cap=c("s_cap")).alias("strategic_eligibility"),
            named(transmission=transmission, dislocation=dislocation, strategic_mode=c("strategic_mode")).alias("strategic_inputs"), of(c("e_score").alias("score"), c("e_label").alias("label")).alias("entry_quality"),
            named(positioning=positioning, turn=turn).alias("entry_inputs"), "action", of("upgrade", "downgrade").alias("triggers"), "price_as_of", "error",
        ), "asset",
    )


#: Radar phases by the bucket they fill, if the asset has a side; phases not to chase need none.
BUCKETS = {
    "EARLY_LONG": "early_longs", "EARLY_SHORT": "early_shorts", "SETUP_LONG": "setup_longs", "SETUP_SHORT": "setup_shorts",
    "CONFIRMED_LONG": "confirmed_longs", "CONFIRMED_SHORT": "confirmed_shorts",
}


def radar_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, rank, ordinal, asset, best_asymmetry, why): the order in a bucket is by rank, then the universe's."""
    names = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))
    bucket = F.when(F.contains("phase", F.lit("DONT_CHASE")), "mature_dont_chase").when(F.col("preferred_side") != "NONE", names[F.col("phase")])
    out = rows.select(bucket.alias("bucket"), "rank", "ordinal", "asset", "asset_class", "best_asymmetry", "preferred_side", "conflicts", F.slice("reasons", 1, 3).alias("why"))
    return out.where("bucket is not null")


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and a document of all columns, as an endpoint would send it."""
    return rows.select(*keys, F.to_json(F.struct(*rows.columns)).alias("document"))
