"""Ranges of positions as few tiles: 1, 2, 4, ... neighbouring rows folded into one, so that no row meets every row of its window.

A tile (level, number) covers the positions from number * 2**level on, 2**level of them. Any range is made of at most two
tiles a level. Tiles and ranges meet by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: tiles of levels with fewer than this many tiles are broadcast: two rows for each at most, over all such levels
FEW_TILES = 4096


def tiles_of(lo: Column, hi: Column, levels: int) -> Column:
    """The (level, tile) of a range of positions, both ends in it, as an array; empty where hi < lo. Levels must reach its length."""
    found = []
    for k in range(levels + 1):
        left, right = F.shiftright(lo + (2**k - 1), k), F.shiftright(hi + 1, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        entry = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.alias("tile"))
        found += [F.when((left < right) & odd(left), entry(left)), F.when((left < right) & odd(right), entry(right - 1))]
    return F.array_compact(F.array(*found))


def levels_for(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> int:
    """The highest level that a tile of any of the ranges can have."""
    longest = ranges.agg(F.max(F.col(hi) - F.col(lo) + 1)).first()[0] or 1
    return max(1, int(longest)).bit_length() - 1


def fold(rows: DataFrame, position: str, levels: int, folds: dict[str, Column]) -> DataFrame:
    """Columns level, tile and the folds (aggregates) of the rows of each tile."""
    up = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(position, k).alias("tile")) for k in range(levels + 1))))
    return rows.select("*", up.alias("_up")).groupBy("_up.level", "_up.tile").agg(*(v.alias(k) for k, v in folds.items()))


def over_ranges(ranges: DataFrame, keys: Sequence[str], tiles: DataFrame, levels: int, folds: dict[str, Column]) -> DataFrame:
    """keys and the folds (aggregates over tiles' columns) of each range (lo, hi); ranges without a position are left out.

    Keep ranges distinct: as many rows meet a tile as there are ranges that it is part of.
    """
    asked = ranges.select(*keys, F.explode(tiles_of(F.col("lo"), F.col("hi"), levels)).alias("_t")).select(*keys, "_t.level", "_t.tile")
    return asked.join(tiles, ["level", "tile"]).groupBy(*keys).agg(*(v.alias(k) for k, v in folds.items()))


def covering(rows: DataFrame, position: str, keys: Sequence[str], count: int, tiles: DataFrame, levels: int, folds: dict[str, Column]) -> DataFrame:
    """keys and the folds over all tiles (as over_ranges() asks for them) that a row's position is in; rows in none are left out.

    Large tiles are met by many rows, but there are few of them: they are broadcast. Of `count` positions a tile of the other levels has at most count / FEW_TILES.
    """
    from_level = max(0, (count // FEW_TILES).bit_length())
    up = lambda ks: F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(position, k).alias("tile")) for k in ks)))
    found = []
    for ks, side in ((range(min(from_level, levels + 1)), tiles.where(F.col("level") < from_level)), (range(from_level, levels + 1), F.broadcast(tiles.where(F.col("level") >= from_level)))):
        if ks:
            found.append(rows.select(*keys, up(ks).alias("_t")).select(*keys, "_t.level", "_t.tile").join(side, ["level", "tile"]).drop("level", "tile"))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.groupBy(*keys).agg(*(v.alias(k) for k, v in folds.items()))
