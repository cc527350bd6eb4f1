"""Bundles that let a run be checked and repeated."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import platform
import sys
import zipfile
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Config
from barloom.operators.bars import FIELDS
from barloom.plans.backtest import Report, backtest

#: Rows of equity, trades or events that a bundle, which is one file, holds at most.
MOST_ROWS = 1_000_000


def data_hash(bars: DataFrame) -> str:
    """A digest of all bars, whatever their order and partitions.

    Every row is hashed where it is; sums of the parts of these hashes, not rows, come together.
    """
    row = F.sha2(F.concat_ws("|", "symbol", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), *[F.coalesce(F.hex(F.col(c).cast("string")), F.lit("")) for c in FIELDS]), 256)
    parts = bars.select(*[F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(8)])
    sums = parts.agg(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(8)]).first()
    return hashlib.sha256(",".join(map(str, sums)).encode()).hexdigest()


def environment() -> dict[str, str]:
    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": pyspark.__version__}


def seed_of(params: dict) -> int | None:
    """The seed among a strategy's parameters: `seed`, else `random_seed`, where it is a whole number."""
    for name in ("seed", "random_seed"):
        try:
            value = float(params[name])
        except (KeyError, TypeError, ValueError):
            continue
        if value == int(value):
            return int(value)
    return None


@dataclass
class Bundle:
    strategy: str
    params: dict
    config: dict
    data_hash: str
    seed: int | None = None
    env: dict = field(default_factory=environment)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    trades: list[dict] = field(default_factory=list)
    risk_events: list[dict] = field(default_factory=list)
    equity: list[float] = field(default_factory=list)
    returns: list[float] = field(default_factory=list)
    measures: dict = field(default_factory=dict)


def _few(df: DataFrame) -> DataFrame:
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write() this run instead")
    return df


def bundle_of(report: Report) -> Bundle:
    """The results of a run of at most MOST_ROWS bars, trades and events, brought together; ValueError beyond that."""
    curve = _few(report.equity).orderBy("bar_idx").collect()
    trades = [r.asDict() | {"ts": r["ts"].isoformat()} for r in _few(report.trades).drop("combo_id").orderBy("bar_idx", "symbol").collect()]
    events = [r.asDict() for r in _few(report.risk_events).drop("combo_id").orderBy("bar", "type").collect()]
    config = asdict(report.config)
    return Bundle(report.strategy, report.params, config, data_hash(report.bars), seed_of(report.params), trades=trades, risk_events=events, equity=[r["equity"] for r in curve], returns=[r["ret"] for r in curve], measures=report.measures())


def write(report: Report, folder: str) -> None:
    """A run of any length: equity (with returns), trades and risk events as Parquet, written by the executors, and a row `manifest`
    of JSON with everything else and the number of rows of each."""
    spark = report.bars.sparkSession
    frames = {"equity": report.equity, "trades": report.trades, "risk_events": report.risk_events}
    for name, frame in frames.items():
        frame.drop("combo_id").write.parquet(f"{folder}/{name}")
    head = {"strategy": report.strategy, "params": report.params, "config": asdict(report.config), "data_hash": data_hash(report.bars), "seed": seed_of(report.params), "env": environment(), "measures": report.measures()}
    head["rows"] = {name: spark.read.parquet(f"{folder}/{name}").count() for name in frames}
    spark.createDataFrame([(_json(head).decode(),)], "manifest string").write.parquet(f"{folder}/manifest")


def replay_written(folder: str, bars: DataFrame) -> dict[str, bool]:
    """Runs again what write() left in folder and says whether bars, equity, trades and risk events are exactly the same."""
    spark = bars.sparkSession
    head = json.loads(spark.read.parquet(f"{folder}/manifest").first()["manifest"])
    again = backtest(bars, head["strategy"], head["params"], Config(**head["config"]))
    out = {"data": data_hash(bars) == head["data_hash"]}
    for name, frame in (("equity", again.equity), ("trades", again.trades), ("risk_events", again.risk_events)):
        saved = spark.read.parquet(f"{folder}/{name}")
        now = frame.drop("combo_id")
        out[name] = saved.count() == head["rows"][name] and saved.exceptAll(now).isEmpty() and now.exceptAll(saved).isEmpty()
    return out


def _json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()


def _csv(rows: list[dict]) -> bytes:
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows({k: f"{v:.17g}" if isinstance(v, float) else v for k, v in r.items()} for r in rows)
    return out.getvalue().encode()


#: The files of a bundle beside its manifest: JSON of parts of it, and CSV of its rows (fixed names).
_PARTS = {"config.json": "config", "env.json": "env", "performance.json": "performance", "risk.json": "risk", "trade_metrics.json": "trade"}
_TABLES = {"trades.csv": "trades", "risk_events.csv": "risk_events"}
_CURVES = {"equity_curve.csv": ("equity", "equity"), "returns.csv": ("returns", "return")}
_MANIFEST = "sha256.json"
_NUMBERS = {"quantity": float, "price": float, "cost": float, "bar_idx": int, "bar": int}


def save(bundle: Bundle, path: str) -> None:
    """A ZIP of JSON and CSV files and a manifest of their digests."""
    given = {"config": bundle.config, "env": bundle.env} | {k: bundle.measures.get(k, {}) for k in ("performance", "risk", "trade")}
    files = {name: _json(given[key]) for name, key in _PARTS.items()}
    files["metadata.json"] = _json({k: getattr(bundle, k) for k in ("strategy", "params", "data_hash", "seed", "created_at")})
    files |= {name: _csv(getattr(bundle, key)) for name, key in _TABLES.items()}
    files |= {name: _csv([{"index": k, column: x} for k, x in enumerate(getattr(bundle, key))]) for name, (key, column) in _CURVES.items()}
    files[_MANIFEST] = _json({name: hashlib.sha256(data).hexdigest() for name, data in files.items()})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)


def load(path: str) -> Bundle:
    """The bundle saved at path; ValueError if a file is missing or has changed."""
    with zipfile.ZipFile(path) as z:
        files = {n: z.read(n) for n in z.namelist()}
    manifest = json.loads(files.get(_MANIFEST, b"null"))
    if not manifest or {*_PARTS, *_TABLES, *_CURVES, "metadata.json"} - set(files) or set(manifest) - set(files):
        raise ValueError("the bundle is incomplete")
    changed = [n for n, digest in manifest.items() if hashlib.sha256(files[n]).hexdigest() != digest]
    if changed:
        raise ValueError(f"the bundle was changed: {', '.join(changed)}")
    rows = {n: list(csv.DictReader(io.StringIO(files[n].decode()))) for n in (*_TABLES, *_CURVES)}
    parts = {key: json.loads(files[name]) for name, key in _PARTS.items()}
    tables = {key: [{k: _NUMBERS.get(k, str)(v) for k, v in r.items()} for r in rows[name]] for name, key in _TABLES.items()}
    curves = {key: [float(r[column]) for r in rows[name]] for name, (key, column) in _CURVES.items()}
    return Bundle(**json.loads(files["metadata.json"]), config=parts.pop("config"), env=parts.pop("env"), measures=parts, **tables, **curves)


def verify(bundle: Bundle, bars: DataFrame, strict: bool = False) -> dict[str, bool]:
    """Whether bars and environment are those of the bundle; with strict, ValueError if not."""
    found = {"data": data_hash(bars) == bundle.data_hash, "environment": environment() == bundle.env}
    if strict and not all(found.values()):
        raise ValueError(f"not the same: {', '.join(k for k, ok in found.items() if not ok)}")
    return found


def replay(bundle: Bundle, bars: DataFrame) -> dict[str, bool]:
    """Runs again and says which of equity, returns, trades and risk events are exactly the same."""
    again = bundle_of(backtest(bars, bundle.strategy, bundle.params, Config(**bundle.config)))
    return {name: getattr(again, name) == getattr(bundle, name) for name in ("equity", "returns", "trades", "risk_events")}
