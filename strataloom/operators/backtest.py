"""Daily backtest: returns of held weights, turnover, borrowing, costs and the equity recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .portfolio import Costs
from .signal import by_ticker


def legs(df: DataFrame, keys=()) -> DataFrame:
    """Per row: w0 (weight before), dw, change (of the price, null if there was none) and vol. Takes weight and close (null: 0, as after a delisting)."""
    spec = by_ticker(*keys)
    df = df.withColumn("price", F.coalesce("close", F.lit(0.0)))
    before = F.lag("price").over(spec)
    df = df.withColumns({"change": F.when(before != 0, F.col("price") / before - 1), "w0": F.coalesce(F.lag("weight").over(spec), F.lit(0.0))})
    frame = spec.rowsBetween(-19, 0)
    vol = F.when(F.count("change").over(frame) >= 2, F.stddev_samp("change").over(frame))
    return df.withColumns({"dw": F.col("weight") - F.col("w0"), "vol": F.coalesce(vol, F.lit(0.02))})


def daily(leg: DataFrame, keys=(), costs: Costs = Costs(), per_year: float = 252.0) -> DataFrame:
    """Per ts: gross, long and short return, turnover, borrow cost."""
    part = F.col("w0") * F.coalesce("change", F.lit(0.0))
    return leg.groupBy(*keys, "ts").agg(
        F.sum(part).alias("gross"), F.sum(F.when(F.col("w0") > 0, part).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("w0") < 0, part).otherwise(0.0)).alias("short"),
        (F.sum(F.abs("dw")) / 2).alias("turnover"), (F.sum(F.greatest(-F.col("w0"), F.lit(0.0))) * costs.borrow / per_year).alias("borrow"),
    )


def _fold(keys: tuple[str, ...], costs: Costs):
    """Folds trades that are sorted by keys and ts. Between batches it holds the equity and the rows of one day."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush():
            nonlocal equity, owner
            rows = pa.Table.from_batches(held).combine_chunks()
            of = tuple(rows[k][0] for k in keys)
            if of != owner:
                owner, equity = of, 1.0
            gross, borrow, dw, vol, adv = (rows[c].to_numpy() for c in ("gross", "borrow", "dw", "vol", "adv"))
            before, share, net = equity, 0.0, 0.0
            if before > 0:
                trades = dw >= 1e-10
                value = dw[trades] * before * costs.capital
                part = np.divide(value, adv[trades], out=np.zeros_like(value), where=adv[trades] > 0)
                bps = costs.commission_bps + costs.spread_bps / 2 + costs.impact * 1e4 * vol[trades] * np.sqrt(part)
                share = float(np.maximum(value * bps / 1e4, costs.minimum).sum() / (before * costs.capital))
                net = float(gross.sum() - share - borrow.sum())
                equity = max(0.0, before * (1 + net))
            out.append((*of, rows["ts"][0], float(gross.sum()), net, equity, share))

        def given():
            columns = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "ts", "gross", "net", "equity", "cost"])

        held, out, owner, equity, last, types = [], [], None, 1.0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [*(batch.column(k).type for k in keys), batch.column("ts").type, *[pa.float64()] * 4]
            at = [batch.column(c) for c in (*keys, "ts")]
            new = np.zeros(batch.num_rows, bool)
            for c in at:
                coded = c.dictionary_encode().indices.to_numpy()
                new[1:] |= coded[1:] != coded[:-1]
            bounds = np.append(np.flatnonzero(new), batch.num_rows)
            begin = 0
            for end in bounds:
                mark = tuple(c[int(begin)] for c in at)
                if held and mark != last:
                    flush()
                    held = []
                held.append(batch.slice(begin, end - begin))
                last, begin = mark, end
            if out:
                yield given()
                out = []
        if held:
            flush()
            yield given()

    return run


def equity_curve(leg: DataFrame, keys=(), costs: Costs = Costs(), per_year: float = 252.0) -> DataFrame:
    """Per ts: gross and net return, equity (of capital 1) and cost share. Takes legs with adv.

    The cost of a day depends on the equity before it, so the days of a key are folded in order, as a stream over sorted rows that holds one day at a time; keys run side by side. At equity 0 the rest is 0.
    """
    part = F.col("w0") * F.coalesce("change", F.lit(0.0))
    borrow = F.greatest(-F.col("w0"), F.lit(0.0)) * costs.borrow / per_year
    rows = leg.select(*keys, "ts", part.alias("gross"), borrow.alias("borrow"), F.abs("dw").alias("dw"), "vol", F.col("adv").cast("double").alias("adv")).fillna(0.0, ["gross", "borrow", "dw", "adv"])
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    named = ", ".join(f"`{k}` {t}" for k, t in leg.select(*keys).dtypes)
    return dealt.sortWithinPartitions(*keys, "ts").mapInArrow(_fold(tuple(keys), costs), f"{named + ', ' if named else ''}ts timestamp, gross double, net double, equity double, cost double")
