"""DuckDB SQL, by recursion over bars, for the queries whose rows depend on the state that earlier rows left."""

from __future__ import annotations

from barloom.plans.oracles import CHANGES, RANGES, W, rows, smoothed, summed

# Simulation under rules

_EACH = "range(1, len(tg) + 1)"


def _over_assets(expression: str) -> str:
    return f"list_transform({_EACH}, lambda i: {expression})"


def ruled(margin: float, position: float, risk: float, daily: float, weekly: float, drawdown: float, cash: float, rate: float = 0.0001, fee: float = 0.0002) -> str:
    """state: equity, ret, turnover, trades and events of each bar of signals (combo_id, symbol, ...), drawdowns halving positions."""
    zeros, d = "list_transform(tg, lambda x: 0.0::DOUBLE)", "::DOUBLE"
    loss = lambda anchor: f"({anchor} - equity) / greatest({anchor}, 1e-12{d})"
    return f"""targets AS (
  SELECT *, coalesce(greatest(-1, least(1, lag(signal) OVER o)), 0)::DOUBLE AS target, lag(close) OVER o AS before FROM signals WINDOW o AS (PARTITION BY combo_id, symbol ORDER BY bar_idx)
), lists AS MATERIALIZED (
  SELECT combo_id, bar_idx, epoch(min(ts))::BIGINT // 86400 AS day, epoch(min(ts))::BIGINT // 604800 AS week, list(open ORDER BY symbol) AS op, list(close ORDER BY symbol) AS cl, list(before ORDER BY symbol) AS bf, list(target ORDER BY symbol) AS tg
  FROM targets GROUP BY 1, 2
), state AS MATERIALIZED (
  SELECT combo_id, bar_idx, {cash}{d} AS equity, {cash}{d} AS peak, day, week, {cash}{d} AS day_anchor, {cash}{d} AS week_anchor, false AS day_stop, false AS week_stop, false AS reducing, false AS told, {zeros} AS held,
    0.0{d} AS ret, 0.0{d} AS turnover, 0::BIGINT AS trades, []::VARCHAR[] AS events FROM lists WHERE bar_idx = 0
  UNION ALL
  SELECT combo_id, bar_idx, equity, peak, day, week, day_anchor, week_anchor, day_stop OR daily, week_stop OR weekly, reducing OR deep, told OR deep, held, ret, turnover, trades,
    CASE WHEN bit THEN ['position_limit|target limited by rules'] ELSE []::VARCHAR[] END || CASE WHEN daily THEN ['daily_loss_breach|' || printf('%.6f', {loss("day_anchor")})] ELSE []::VARCHAR[] END
      || CASE WHEN weekly THEN ['weekly_loss_breach|' || printf('%.6f', {loss("week_anchor")})] ELSE []::VARCHAR[] END || CASE WHEN deep AND NOT told THEN ['drawdown_breach|' || printf('%.6f', {loss("peak")})] ELSE []::VARCHAR[] END
  FROM (SELECT *, NOT day_stop AND {loss("day_anchor")} >= {daily} AS daily, NOT week_stop AND {loss("week_anchor")} >= {weekly} AS weekly, {loss("peak")} >= {drawdown} AS deep
  FROM (SELECT * EXCLUDE (peak), greatest(peak, equity) AS peak, (equity - e0) / CASE WHEN e0 > 1 THEN e0 ELSE 1 END AS ret
  FROM (SELECT * EXCLUDE (held), c4 AS held, list_sum({_over_assets("abs(c4[i] - held[i])")}) AS turnover, len(list_filter({_over_assets("abs(c4[i] - held[i])")}, lambda x: x >= 1e-12))::BIGINT AS trades,
    greatest(e0 + list_sum({_over_assets("held[i] * (op[i] - bf[i]) + c4[i] * (cl[i] - op[i])")})
      - list_sum({_over_assets(f"abs(op[i] * (1 + CASE WHEN c4[i] - held[i] >= 0 THEN {rate}{d} ELSE -{rate}{d} END) - op[i]) * abs(c4[i] - held[i]) + abs(op[i] * (1 + CASE WHEN c4[i] - held[i] >= 0 THEN {rate}{d} ELSE -{rate}{d} END)) * abs(c4[i] - held[i]) * {fee}{d}")}), 0) AS equity
  FROM (SELECT *, CASE WHEN needed > e0 THEN list_transform(c3, lambda x: x * greatest(e0 / (needed + 1e-12), 0)) ELSE c3 END AS c4, b3 OR needed > e0 AS bit
  FROM (SELECT *, {margin}{d} * list_sum({_over_assets("abs(c3[i]) * op[i]")}) AS needed
  FROM (SELECT *, CASE WHEN e0 > 0 AND wanted > {risk}{d} * e0 THEN {_over_assets(f"held[i] + (c2[i] - held[i]) * ({risk}{d} * e0) / (wanted + 1e-12)")} ELSE c2 END AS c3, b2 OR (e0 > 0 AND wanted > {risk}{d} * e0) AS b3
  FROM (SELECT *, list_sum({_over_assets("abs(c2[i] - held[i]) * op[i]")}) AS wanted, b1 OR list_bool_or({_over_assets("abs(c2[i] - c1[i]) > 1e-8 + 1e-5 * abs(c1[i])")}) AS b2
  FROM (SELECT *, list_transform(c1, lambda x: greatest(-{position}{d}, least({position}{d}, x))) AS c2
  FROM (SELECT *, CASE WHEN day_stop OR week_stop THEN {zeros} WHEN reducing THEN list_transform(tg, lambda x: x * 0.5) ELSE tg END AS c1, reducing OR day_stop OR week_stop AS b1
  FROM (SELECT l.*, s.equity AS e0, s.peak, s.held, s.reducing, s.told, CASE WHEN l.day <> s.day THEN s.equity ELSE s.day_anchor END AS day_anchor, CASE WHEN l.week <> s.week THEN s.equity ELSE s.week_anchor END AS week_anchor,
      l.day = s.day AND s.day_stop AS day_stop, l.week = s.week AND s.week_stop AS week_stop
    FROM state s JOIN lists l ON l.combo_id = s.combo_id AND l.bar_idx = s.bar_idx + 1))))))))))
)"""


# Parabolic stops and the assistants

NEAR = f"near AS MATERIALIZED (SELECT *, lead(close) OVER ({W}) AS following, lag(low) OVER ({W}) AS l1, lag(low, 2) OVER ({W}) AS l2, lag(high) OVER ({W}) AS h1, lag(high, 2) OVER ({W}) AS h2 FROM bars)"


def stop_levels(name: str, step: float, most: float = 0.2) -> str:
    """The stop-and-reverse level `sar` of each bar of near."""
    step_, most_ = f"{step}::DOUBLE", f"{most}::DOUBLE"
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, bar_idx, following > close AS up, {step_} AS af, CASE WHEN following > close THEN high ELSE low END AS ep, CASE WHEN following > close THEN low ELSE high END AS sar FROM near WHERE bar_idx = 0
  UNION ALL
  SELECT symbol, bar_idx, CASE WHEN turns THEN NOT up ELSE up END, CASE WHEN turns THEN {step_} WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + {step_}, {most_}) ELSE af END,
    CASE WHEN turns THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(high, ep) ELSE least(low, ep) END, CASE WHEN turns THEN ep ELSE s END
  FROM (SELECT *, CASE WHEN up THEN s > low ELSE s < high END AS turns FROM (
    SELECT n.*, p.up, p.af, p.ep, CASE WHEN p.up THEN least(p.sar + p.af * (p.ep - p.sar), l1, coalesce(l2, l1)) ELSE greatest(p.sar + p.af * (p.ep - p.sar), h1, coalesce(h2, h1)) END AS s
    FROM {name} p JOIN near n ON n.symbol = p.symbol AND n.bar_idx = p.bar_idx + 1))
)"""


RSI = [CHANGES, smoothed("g", "changes", "gain", "1.0::DOUBLE / 14"), smoothed("l", "changes", "loss", "1.0::DOUBLE / 14"), "rsis AS MATERIALIZED (SELECT symbol, bar_idx, 100 - 100 / (1 + g.v / (l.v + 1e-12)) AS rsi FROM g JOIN l USING (symbol, bar_idx))"]
ADX = [
    RANGES, "moves AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN bar_idx > 0 AND up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN bar_idx > 0 AND dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm, CASE WHEN bar_idx > 0 THEN tr ELSE 0 END AS tr FROM ranges)",
    summed("p", "moves", "pdm", 14), summed("q", "moves", "mdm", 14), summed("t", "moves", "tr", 14),
    "di AS (SELECT symbol, bar_idx, CASE WHEN t.v > 0 THEN p.v * 100 / t.v ELSE 0 END AS plus_di, CASE WHEN t.v > 0 THEN q.v * 100 / t.v ELSE 0 END AS minus_di FROM p JOIN q USING (symbol, bar_idx) JOIN t USING (symbol, bar_idx))",
    "dx AS MATERIALIZED (SELECT *, CASE WHEN plus_di + minus_di > 0 THEN abs(plus_di - minus_di) * 100 / (plus_di + minus_di) ELSE 0 END AS dx FROM di)",
    "terms AS MATERIALIZED (SELECT symbol, bar_idx, CASE bar_idx WHEN 0 THEN 0 WHEN 1 THEN dx ELSE dx / 14 END AS u FROM dx)", summed("a", "terms", "u", 14),
]


def _lag(column: str, k: int = 1) -> str:
    return f"lag({column}, {k}) OVER ({W})"


#: All that the assistants look at; atr_ratio over 30 bars.
SEEN = [
    *RSI, *ADX, NEAR, stop_levels("slow_sar", 0.015), stop_levels("mid_sar", 0.025), stop_levels("fast_sar", 0.04),
    smoothed("e", "ranges", "tr", "2.0::DOUBLE / 15"), smoothed("mf", "bars", "close", "2.0::DOUBLE / 21"), smoothed("ms", "bars", "close", "2.0::DOUBLE / 51"),
    f"vols AS MATERIALIZED (SELECT symbol, bar_idx, v AS atr, CASE WHEN bar_idx >= 29 THEN median(v) OVER {rows(30)} END AS m FROM e)",
    "seen AS MATERIALIZED (SELECT b.*, atr, CASE WHEN m > 0 THEN atr / m ELSE 1 END AS ratio, rsi, a.v AS adx, plus_di, minus_di, mf.v AS ma_fast, ms.v AS ma_slow, slow_sar.sar AS sar_low, mid_sar.sar AS sar_mid, fast_sar.sar AS sar_high FROM bars b JOIN vols USING (symbol, bar_idx) "
    "JOIN rsis USING (symbol, bar_idx) JOIN a USING (symbol, bar_idx) JOIN dx USING (symbol, bar_idx) JOIN mf USING (symbol, bar_idx) JOIN ms USING (symbol, bar_idx) JOIN slow_sar USING (symbol, bar_idx) JOIN mid_sar USING (symbol, bar_idx) JOIN fast_sar USING (symbol, bar_idx))",
]

#: The bars before, of which the third assistant takes the stop levels at the pace of the present bar.
V3 = [
    f"""before AS (SELECT symbol, bar_idx, {_lag("close")} AS c1, {_lag("close", 2)} AS c2, {_lag("open")} AS o1, {_lag("atr")} AS atr1, {_lag("rsi")} AS rsi1, {_lag("adx")} AS adx1, {_lag("plus_di")} AS pd1, {_lag("minus_di")} AS md1, {_lag("ma_fast")} AS f1, {_lag("ma_slow")} AS s1,
  CASE WHEN ratio < 0.7 THEN {_lag("sar_low")} WHEN ratio > 1.5 THEN {_lag("sar_high")} ELSE {_lag("sar_mid")} END AS sar1, CASE WHEN ratio < 0.7 THEN {_lag("sar_low", 2)} WHEN ratio > 1.5 THEN {_lag("sar_high", 2)} ELSE {_lag("sar_mid", 2)} END AS sar2 FROM seen)""",
    """turns AS (SELECT symbol, bar_idx, CASE WHEN bar_idx < 60 OR NOT (adx1 >= 10 AND rsi1 > 25 AND rsi1 < 75 AND atr1 > 0 AND abs(c1 - o1) <= atr1 * 2.5) THEN 0 WHEN sar2 >= c2 AND sar1 < c1 AND pd1 > md1 AND c1 > f1 AND f1 >= s1 THEN 1
  WHEN sar2 <= c2 AND sar1 > c1 AND md1 > pd1 AND c1 < f1 AND f1 <= s1 THEN -1 ELSE 0 END AS turn FROM before)""",
]
V3_SIGNAL = f"coalesce(last_value(nullif(turn, 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"

#: The fourth assistant with gates of ADX alone and all of its risk management but the trailing by ATR.
V4 = [
    "paced AS (SELECT *, CASE WHEN ratio < 0.7 THEN sar_low WHEN ratio > 1.5 THEN sar_high ELSE sar_mid END AS sar FROM seen)",
    f"""looks AS (SELECT *, {_lag("close")} AS c1, {_lag("close", 2)} AS c2, {_lag("sar")} AS sar1, {_lag("sar", 2)} AS sar2, {_lag("adx")} AS adx1, {_lag("plus_di")} AS pd1, {_lag("minus_di")} AS md1, CASE WHEN {_lag("atr")} > 0 THEN {_lag("atr")} ELSE 1 END AS unit,
  min(low) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lows, max(high) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS highs, bar_idx >= 60 AND count(*) OVER (PARTITION BY symbol) >= 60 AS ready FROM paced)""",
    "ways AS (SELECT *, CASE WHEN NOT ready OR adx1 < 10 THEN 0 WHEN sar2 >= c2 AND sar1 < c1 THEN CASE WHEN pd1 > md1 THEN 1 ELSE 0 END WHEN sar2 <= c2 AND sar1 > c1 AND md1 > pd1 THEN -1 ELSE 0 END AS way FROM looks)",
    """stops AS MATERIALIZED (SELECT *, CASE WHEN way > 0 THEN least(c1 - unit * 1.5, lows - unit * 0.2) WHEN way < 0 THEN greatest(c1 + unit * 1.5, highs + unit * 0.2) END AS first FROM ways)""",
    """trade AS MATERIALIZED (
  SELECT symbol, bar_idx, 0.0::DOUBLE AS size, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS first, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS t2, 0 AS age, false AS partly, false AS safe, false AS added FROM stops WHERE bar_idx = 0
  UNION ALL
  SELECT symbol, bar_idx, CASE WHEN enters THEN 0.6 * way ELSE size END, CASE WHEN enters THEN c1 ELSE entry END, CASE WHEN enters THEN new_first ELSE stop END, CASE WHEN enters THEN new_first ELSE first END,
    CASE WHEN enters THEN c1 + way * abs(c1 - new_first) ELSE t1 END, CASE WHEN enters THEN c1 + way * 2 * abs(c1 - new_first) ELSE t2 END, CASE WHEN enters THEN 0 ELSE age END, NOT enters AND partly, NOT enters AND safe, NOT enters AND added
  FROM (SELECT *, ready AND NOT ended AND way <> 0 AND (size = 0 OR sign(size) <> way) AS enters
  FROM (SELECT * EXCLUDE (size, added), CASE WHEN ended OR NOT ready THEN 0 WHEN adds THEN w * least(abs(size) + 0.4, 1) ELSE size END AS size, added OR adds AS added
  FROM (SELECT *, NOT added AND partly AND NOT ended AND w * (close - ma_fast) > 0 AND w * (t1 - close) > 0 AS adds
  FROM (SELECT * EXCLUDE (ended), ended OR (w <> 0 AND age >= 30 AND risk > 0 AND w * (close - entry) / risk < 0.3) AS ended
  FROM (SELECT * EXCLUDE (stop, safe), CASE WHEN lifts THEN CASE WHEN w > 0 THEN greatest(stop, entry + w * 0.1 * risk) ELSE least(stop, entry + w * 0.1 * risk) END ELSE stop END AS stop, safe OR lifts AS safe
  FROM (SELECT *, w <> 0 AND NOT safe AND entry > 0 AND first <> 0 AND risk > 0 AND w * (close - entry) >= 0.5 * risk AS lifts
  FROM (SELECT * EXCLUDE (stop, size, partly), CASE WHEN w <> 0 AND sar > 0 AND w * (close - sar) > 0 AND w * (sar - stop) > 0 THEN sar ELSE stop END AS stop, CASE WHEN halves THEN size * 0.5 ELSE size END AS size, partly OR halves AS partly
  FROM (SELECT *, w <> 0 AND (w * (bad - stop) <= 0 OR w * (good - t2) >= 0) AS ended, w <> 0 AND NOT partly AND w * (good - t1) >= 0 AS halves
  FROM (SELECT n.symbol, n.bar_idx, n.close, n.sar, n.ma_fast, n.way, n.c1, n.ready, n.first AS new_first, s.size, s.entry, s.stop, s.first, s.t1, s.t2, s.age + 1 AS age, s.partly, s.safe, s.added, CASE WHEN n.ready THEN sign(s.size) ELSE 0 END AS w, abs(s.entry - s.first) AS risk,
      CASE WHEN s.size > 0 THEN n.high ELSE n.low END AS good, CASE WHEN s.size > 0 THEN n.low ELSE n.high END AS bad
    FROM trade s JOIN stops n ON n.symbol = s.symbol AND n.bar_idx = s.bar_idx + 1)))))))))
)""",
]

#: The fourth assistant's confirmations, one a set (MACD, volume, session, momentum), under first stops and trailing by ATR.
V4_GATES = [
    "paced AS (SELECT *, CASE WHEN ratio < 0.7 THEN sar_low WHEN ratio > 1.5 THEN sar_high ELSE sar_mid END AS sar FROM seen)",
    smoothed("quick", "bars", "close", "2.0::DOUBLE / 13"), smoothed("calm", "bars", "close", "2.0::DOUBLE / 27"), "line AS MATERIALIZED (SELECT symbol, bar_idx, quick.v - calm.v AS macd FROM quick JOIN calm USING (symbol, bar_idx))", smoothed("sign_line", "line", "macd", "2.0::DOUBLE / 10"),
    f"typical AS (SELECT *, (high + low + close) / 3 AS tp FROM paced), lists AS (SELECT *, avg(tp) OVER {rows(14)} AS tp_mean, list(tp) OVER {rows(14)} AS tps, avg(volume) OVER {rows(20)} AS vol_ma, max(high) OVER {rows(20)} AS upper, min(low) OVER {rows(20)} AS lower FROM typical)",
    "spread AS (SELECT *, list_sum(list_transform(tps, lambda x: abs(x - tp_mean))) / 14 AS dev FROM lists)",
    "told AS (SELECT spread.*, macd - v AS hist, (tp - tp_mean) / (0.015 * CASE WHEN dev > 0 THEN dev ELSE 1e-12 END) AS cci FROM spread JOIN line USING (symbol, bar_idx) JOIN sign_line USING (symbol, bar_idx))",
    f"""looks AS (SELECT *, {_lag("close")} AS c1, {_lag("close", 2)} AS c2, {_lag("sar")} AS sar1, {_lag("sar", 2)} AS sar2, {_lag("hist")} AS hist1, {_lag("hist", 2)} AS hist2, {_lag("volume")} AS vol1, {_lag("vol_ma")} AS vol_ma1, {_lag("upper", 2)} AS upper2, {_lag("lower", 2)} AS lower2, {_lag("cci")} AS cci1,
  CASE WHEN {_lag("atr")} > 0 THEN {_lag("atr")} ELSE 1 END AS unit, bar_idx >= 60 AND count(*) OVER (PARTITION BY symbol) >= 60 AS ready FROM told)""",
    """gated AS (SELECT *, CASE combo_id WHEN 0 THEN hist1 > 0 AND hist1 > hist2 WHEN 1 THEN NOT (vol_ma1 > 0 AND vol1 <= vol_ma1 * 1.1) WHEN 2 THEN NOT (hour(ts) >= 0 AND hour(ts) < 8) ELSE (upper2 > 0 AND c1 > upper2) OR cci1 > 80 END AS long_ok,
  CASE combo_id WHEN 0 THEN hist1 < 0 AND hist1 < hist2 WHEN 1 THEN NOT (vol_ma1 > 0 AND vol1 <= vol_ma1 * 1.1) WHEN 2 THEN NOT (hour(ts) >= 0 AND hour(ts) < 8) ELSE (lower2 > 0 AND c1 < lower2) OR cci1 < -80 END AS short_ok FROM looks CROSS JOIN range(4) k(combo_id))""",
    "ways AS MATERIALIZED (SELECT *, CASE WHEN NOT ready THEN 0 WHEN sar2 >= c2 AND sar1 < c1 THEN CASE WHEN long_ok THEN 1 ELSE 0 END WHEN sar2 <= c2 AND sar1 > c1 AND short_ok THEN -1 ELSE 0 END AS way FROM gated)",
    """trade AS MATERIALIZED (
  SELECT combo_id, symbol, bar_idx, 0.0::DOUBLE AS size, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS best FROM ways WHERE bar_idx = 0
  UNION ALL
  SELECT combo_id, symbol, bar_idx, CASE WHEN enters THEN way WHEN ended OR w = 0 THEN 0 ELSE size END::DOUBLE, CASE WHEN enters THEN c1 - way * unit * 1.5 ELSE stop END::DOUBLE, CASE WHEN enters THEN CASE WHEN way > 0 THEN high ELSE low END ELSE best END::DOUBLE
  FROM (SELECT *, ready AND NOT ended AND way <> 0 AND w <> way AS enters
  FROM (SELECT * EXCLUDE (stop), CASE WHEN w <> 0 AND NOT ended AND atr > 0 AND (stop = 0 OR w * (best - w * 2 * atr - stop) > 0) THEN best - w * 2 * atr ELSE stop END AS stop
  FROM (SELECT * EXCLUDE (best), w <> 0 AND stop <> 0 AND w * (CASE WHEN w > 0 THEN low ELSE high END - stop) <= 0 AS ended, CASE WHEN w > 0 THEN greatest(best, high) WHEN w < 0 THEN least(best, low) ELSE best END AS best
  FROM (SELECT n.combo_id, n.symbol, n.bar_idx, n.high, n.low, n.atr, n.way, n.c1, n.unit, n.ready, s.size, s.stop, s.best, CASE WHEN n.ready THEN sign(s.size) ELSE 0 END AS w
    FROM trade s JOIN ways n ON n.combo_id = s.combo_id AND n.symbol = s.symbol AND n.bar_idx = s.bar_idx + 1))))
)""",
]
