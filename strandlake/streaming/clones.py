"""The clone filter over a stream of mapped pairs that arrive in the order of their store.

State of each tile of positions (sample, contig, class): the UMI of the last row of each place (lo, hi). Rows of one place and UMI are reduced to their
first one and a count before they are sent to the state, and again there: a task holds the different places and UMIs of a tile, whatever the depth, and
the state its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandlake.operators.filters import PAIR_ORDER, with_order_keys

PLACE = ["sample", "chr", "klass", "lo", "hi"]
TIES = PAIR_ORDER[3:]
#: Fixed value: a session runs these streams with this state store, as arbitrary state needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def same_molecule(umi: str | None, before: str | None) -> bool:
    """Whether UMIs differ in one base at most; a row without one may belong to any."""
    return umi is None or before is None or sum(a != b for a, b in zip_longest(umi, before)) <= 1


def by_umi(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of each UMI in the store's order, with the number of its rows (n)."""
    ordered = rows.sort_values(TIES, kind="stable")
    keys = [*PLACE, "umi"]
    first = ordered.drop_duplicates(keys)
    return first.drop(columns="n").merge(ordered.groupby(keys, dropna=False, as_index=False)["n"].sum(), on=keys)


class LastUmis(StatefulProcessor):
    """Rows of a tile of positions, one per place and UMI: kept unless the row before at the place has a UMI that differs in one base at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getListState("last", "lo long, hi long, umi string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = None
        for part in rows:
            held = by_umi(part if held is None else pd.concat([held, part]))
        held = held.sort_values(["lo", "hi", "umi"], na_position="first")
        last, kept = {(lo, hi): umi for lo, hi, umi in self._last.get()}, []
        for lo, hi, umi in zip(held["lo"].tolist(), held["hi"].tolist(), (None if pd.isna(x) else x for x in held["umi"]), strict=True):
            place = (lo, hi)
            kept.append(place not in last or not same_molecule(umi, last[place]))
            last[place] = umi
        self._last.put([(*place, umi) for place, umi in last.items()])
        yield held.assign(kept=kept)

    def close(self) -> None:
        pass


def kept_pairs(pairs: DataFrame, tile: int = 1024) -> DataFrame:
    """sample, chr, klass, lo, hi, umi, ordinal, n, kept of a stream of pairs: a row for each UMI of a pair of positions in a micro-batch, with the ordinal
    of its first row, the number of its rows (all but the first are clones) and whether the first one is kept.

    What arrives together is put in the store's order; what arrives later comes behind, as in a store that is read to its end. A pair that arrives
    again is a clone. The output mode is append or update."""
    columns = ["sample", "chr", "klass", "tile", "lo", "hi", "umi", "ordinal", *TIES, "n"]
    keyed = with_order_keys(pairs).withColumn("tile", F.expr(f"lo div {tile}")).selectExpr(*columns[:-1], "1L as n")

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (by_umi(f)[columns] for f in frames if len(f))

    fewer = keyed.mapInPandas(reduce, keyed.schema)
    out = fewer.schema.simpleString()[len("struct<") : -1]
    return fewer.groupBy("sample", "chr", "klass", "tile").transformWithStateInPandas(LastUmis(), f"{out},kept:boolean", "append", "none").drop("tile", *TIES)
