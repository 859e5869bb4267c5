"""Exact running counts and sums within groups, safe for hot groups.

``Window.partitionBy(group).orderBy(...)`` sends every row of a group to one
task; when one group (one day, one product) holds a third of all rows that
task holds a third of the data. Here the rows are instead range-partitioned
on ``(group, order)``: the range partitioner samples the keys and cuts a hot
group across many partitions, each a contiguous slice of the order. Each
partition computes its local running sums (Arrow batches; only group and value
columns become pandas, all others pass through untouched), and the
only cross-partition information is what the rows of a group in earlier
partitions add up to: one summary row per partition, O(partitions), never
O(rows). The partitioned rows are written to the shared checkpoint folder
first, so both passes read the same partitions and a lost executor only
recomputes its own part.

Group columns must be integers or strings (convert dates first); a NULL group
is refused with an error.
"""

from __future__ import annotations

import json
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockline.session import cut_lineage


def running_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, str | None],
                   inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Add one running total per entry of ``values`` (output name -> input
    column, or None for a row count) within ``group`` in ``order``.

    ``inclusive=False`` gives the total of the rows strictly before each row.
    Values must be integers (counts, quantities); totals are ``bigint``.
    ``partitions`` fixes the number of ranges; by default it is
    ``spark.sql.shuffle.partitions`` ranges, merged by AQE to its advisory
    partition size. Each range is one task.
    """
    # Everything the tasks run is defined in here, so it ships with the task
    # (by value) and the workers need nothing but pandas.
    def _key_json(values) -> str:
        return json.dumps([v.item() if hasattr(v, "item") else v for v in values])

    outs = list(values)
    work = df
    for name, src in values.items():
        work = work.withColumn(f"_v_{name}", F.lit(1).cast("bigint") if src is None
                               else F.col(src).cast("bigint"))
    keys = group + order
    # Without an explicit count, AQE sizes the ranges from the data (it only
    # merges neighbouring ranges, so every partition is still one contiguous
    # range of the order).
    ranged = (work.repartitionByRange(partitions, *keys) if partitions
              else work.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ranged = cut_lineage(ranged).withColumn("_pid", F.spark_partition_id())
    vcols = [f"_v_{o}" for o in outs]

    # Pass 1: per partition, its first / last group, the totals of its last
    # group, its grand totals and whether it holds a single group.
    summary_schema = T.StructType(
        [T.StructField("pid", T.IntegerType()), T.StructField("first_key", T.StringType()),
         T.StructField("last_key", T.StringType()), T.StructField("single", T.BooleanType())]
        + [T.StructField(f"last_{o}", T.LongType()) for o in outs]
        + [T.StructField(f"all_{o}", T.LongType()) for o in outs])

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = pid = None
        single = True
        last_tot = [0] * len(outs)
        all_tot = [0] * len(outs)
        for pdf in batches:
            if pdf.empty:
                continue
            if pdf[group].isna().any(axis=None):
                raise ValueError(f"running totals need non-null groups: {group}")
            pid = int(pdf["_pid"].iloc[0])
            if first is None:
                first = _key_json(pdf[group].iloc[0].tolist())
            tail_vals = pdf[group].iloc[-1].tolist()
            tail_key = _key_json(tail_vals)
            mask = pd.Series(True, index=pdf.index)
            for c, v in zip(group, tail_vals):
                mask &= pdf[c] == v
            # Rows are sorted: if the batch ends in the group the previous
            # batch ended in, the whole batch is that group.
            continues = tail_key == last
            for i, vc in enumerate(vcols):
                t = int(pdf.loc[mask, vc].sum())
                all_tot[i] += int(pdf[vc].sum())
                last_tot[i] = last_tot[i] + t if continues else t
            single = single and bool(mask.all()) and tail_key == first
            last = tail_key
        if pid is not None:
            row = {"pid": pid, "first_key": first, "last_key": last, "single": single}
            for i, o in enumerate(outs):
                row[f"last_{o}"] = last_tot[i]
                row[f"all_{o}"] = all_tot[i]
            yield pd.DataFrame([row])

    needed = list(dict.fromkeys(group + vcols + ["_pid"]))
    summary = ranged.select(*needed).mapInPandas(summarize, summary_schema).collect()  # one row per partition
    summary = sorted(summary, key=lambda r: r["pid"])

    # Carry-in of each partition's first group from the partitions before it.
    offsets: dict[int, list[int]] = {}
    carry_key, carry = None, [0] * len(outs)
    for r in summary:
        off = carry if r["first_key"] == carry_key else [0] * len(outs)
        offsets[r["pid"]] = list(off)
        if r["single"]:
            carry = [off[i] + r[f"all_{o}"] for i, o in enumerate(outs)]
        else:
            carry = [r[f"last_{o}"] for o in outs]
        carry_key = r["last_key"]
    first_keys = {r["pid"]: r["first_key"] for r in summary}

    out_schema = T.StructType(list(ranged.schema.fields)
                              + [T.StructField(o, T.LongType()) for o in outs])

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry_key = None
        carry_vals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = batch.select(needed).to_pandas()
            if carry_key is None:
                pid = int(pdf["_pid"].iloc[0])
                carry_key = json.loads(first_keys[pid])
                carry_vals = offsets[pid]
            grouped = pdf.groupby(group, sort=False, dropna=False)
            mask = pd.Series(True, index=pdf.index)
            for c, v in zip(group, carry_key):
                mask &= pdf[c] == v
            tail = pdf[group].iloc[-1].tolist()
            new_vals = []
            totals = []
            for vc, carried in zip(vcols, carry_vals):
                csum = grouped[vc].cumsum().astype("int64")
                csum = csum + mask.astype("int64") * int(carried)
                new_vals.append(int(csum.iloc[-1]))
                total = csum if inclusive else csum - pdf[vc].astype("int64")
                totals.append(pa.array(total.to_numpy(), pa.int64()))
            carry_key = [v.item() if hasattr(v, "item") else v for v in tail]
            carry_vals = new_vals
            yield pa.RecordBatch.from_arrays(batch.columns + totals, batch.schema.names + outs)

    result = ranged.mapInArrow(accumulate, out_schema)
    return result.drop("_pid", *vcols)
