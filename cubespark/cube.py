"""The cube: one row a cell, with an index column i_<dim> and a label column <dim> for each dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cubespark.functions import missing_to_null

#: Labels an axis may have; axes are driver-side metadata.
MAX_AXIS = 2_000_000
#: Axes of at most so many labels are looked up in a literal, longer ones in a table.
LITERAL_AXIS = 64
RESERVED = ("split", "filter_mask")


class Axes(Mapping):
    """Labels of each dimension, read from the data (all missing ones in one pass) when one is first asked for."""

    def __init__(self, names: Sequence[str], known: Mapping[str, Sequence], load: Callable[[list[str]], dict[str, list]]):
        self._names, self._known, self._load = list(names), {d: list(v) for d, v in known.items()}, load

    def __getitem__(self, dim: str) -> list:
        if dim not in self._known:
            if dim not in self._names:
                raise KeyError(dim)
            self._known |= self._load([d for d in self._names if d not in self._known])
        return self._known[dim]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Cube:
    """Cells and metadata. axes holds the labels of each dimension in index order; chunks its default chunk sizes.

    df has all cells of the axes, made when first asked for. seen, if known, has labels and variables of the cells that
    rows fell into: what passes over missing values reads it and needs no grid.
    """

    def __init__(self, df: DataFrame | Callable[[], DataFrame], axes: Mapping[str, list], variables: Sequence[str], chunks: dict[str, int], seen: DataFrame | None = None):
        self._df, self.axes, self.variables, self.chunks, self.seen = df, axes, tuple(variables), chunks, seen

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @property
    def observed(self) -> DataFrame:
        """Labels and variables of all cells with a value, and perhaps of others."""
        return self.df if self.seen is None else self.seen

    def known(self, *variables: str) -> DataFrame:
        """Cells, with indices, where none of the variables is missing."""
        return self.indexed(self.observed.na.drop(subset=list(variables or self.variables)))

    def indexed(self, df: DataFrame) -> DataFrame:
        """df with i_<dim> for the dimensions whose labels it has."""
        for d in self.dims:
            if d not in df.columns or f"i_{d}" in df.columns:
                continue
            labels = self.axes[d]
            if labels == list(range(len(labels))):
                df = df.withColumn(f"i_{d}", F.col(d).cast("bigint"))
            elif len(labels) <= LITERAL_AXIS:
                df = df.withColumn(f"i_{d}", F.array_position(F.lit(labels).cast(f"array<{df.schema[d].dataType.simpleString()}>"), F.col(d)) - 1).where(f"`i_{d}` >= 0")
            else:
                df = df.join(self.axis_table(d), d)
        return df

    def grid(self, *dims: str) -> DataFrame:
        """_cell (row-major), i_<dim> and <dim> of all cells of some dimensions: a distributed range, whatever its size."""
        sizes, stride, n = self.sizes, 1, 1
        for d in dims:
            n *= sizes[d]
        out = self.observed.sparkSession.range(n).withColumnRenamed("id", "_cell")
        for d in reversed(dims):
            out = out.withColumn(f"i_{d}", F.expr(f"(_cell div {stride}) % {sizes[d]}"))
            stride *= sizes[d]
        for d in dims:
            labels = self.axes[d]
            if 0 < len(labels) <= LITERAL_AXIS:
                kind = self.observed.schema[d].dataType.simpleString()
                out = out.withColumn(d, F.element_at(F.lit(labels).cast(f"array<{kind}>"), (F.col(f"i_{d}") + 1).cast("int")))
            else:
                out = out.join(self.axis_table(d), f"i_{d}")
        return out

    @property
    def dims(self) -> list[str]:
        return list(self.axes)

    @property
    def sizes(self) -> dict[str, int]:
        return {d: len(v) for d, v in self.axes.items()}

    @property
    def cells(self) -> int:
        n = 1
        for size in self.sizes.values():
            n *= size
        return n

    @property
    def data_variables(self) -> list[str]:
        return [v for v in self.variables if v not in RESERVED]

    def index(self, *dims: str) -> list[str]:
        return [f"i_{d}" for d in (dims or self.dims)]

    def with_df(self, df: DataFrame, variables: Sequence[str] | None = None) -> Cube:
        return Cube(df, self.axes, tuple(variables or self.variables), self.chunks)

    def axis_table(self, dim: str) -> DataFrame:
        """(i_<dim>, <dim>) of one axis; local data, so that Spark knows its size and broadcasts it only if small."""
        labels = pa.array(self.axes[dim], to_arrow_type(self.observed.schema[dim].dataType))
        return self.observed.sparkSession.createDataFrame(pa.table({f"i_{dim}": pa.array(range(len(labels)), pa.int64()), dim: labels}))

    def select(self, *variables: str) -> Cube:
        """Variable projection."""
        seen = None if self.seen is None else self.seen.select(*self.dims, *variables)
        return Cube(lambda: self.df.select(*self.index(), *self.dims, *variables), self.axes, variables, self.chunks, seen)

    def assign(self, **columns: Column) -> Cube:
        """New or replaced variables."""
        return self.with_df(self.df.withColumns(columns), [*dict.fromkeys([*self.variables, *columns])])

    def rename(self, old: str, new: str) -> Cube:
        return self.with_df(self.df.withColumnRenamed(old, new), [new if v == old else v for v in self.variables])

    def rename_dims(self, names: list[str]) -> Cube:
        """Dimensions named anew in order; with fewer names than dimensions the rest keep theirs."""
        pairs = dict(zip(self.dims, names, strict=False))
        df = self.df.withColumnsRenamed({f"i_{a}": f"i_{b}" for a, b in pairs.items()} | pairs)
        return Cube(df, {pairs.get(d, d): v for d, v in self.axes.items()}, self.variables, {pairs.get(d, d): c for d, c in self.chunks.items()})

    def cell_number(self) -> Column:
        """Row-major number of the cell."""
        return row_major([(F.col(f"i_{d}"), n) for d, n in self.sizes.items()])


def row_major(parts: list[tuple[Column, int]]) -> Column:
    out = F.lit(0).cast("bigint")
    for index, size in parts:
        out = out * F.lit(size) + index
    return out


def axis_labels(df: DataFrame, names: list[str]) -> dict[str, list]:
    """Sorted distinct labels of the columns, in one pass over those columns alone; too long an axis is an error.

    Each label is a row of its own, told apart in parallel; no more rows than axes may have reach the driver.
    """
    if not names:
        return {}
    kinds = {n: df.schema[n].dataType for n in names}
    one = [F.struct(F.lit(k).alias("_k"), *[(F.col(m) if m == n else F.lit(None).cast(kinds[m])).alias(m) for m in names]) for k, n in enumerate(names)]
    rows = df.select(F.explode(F.array(*one)).alias("_l")).select("_l.*").distinct().limit(len(names) * MAX_AXIS + 1).collect()
    found: dict[str, list] = {n: [] for n in names}
    for r in rows:
        if r[names[r["_k"]]] is not None:
            found[names[r["_k"]]].append(r[names[r["_k"]]])
    for n in names:
        if len(found[n]) > MAX_AXIS:
            raise ValueError(f"axis {n} has more than {MAX_AXIS} labels; use a coarser one")
    return {n: sorted(found[n]) for n in names}


def from_table(df: DataFrame, dims: dict[str, Column], values: dict[str, Column], axes: dict[str, Sequence] | None = None, chunks: dict[str, int] | None = None) -> Cube:
    """A cube of a table: dims are label expressions, values aggregates of the rows in a cell.

    Rows are aggregated before axes meet them. Cells without rows exist and hold NULL: gap counts depend on that. Axes that
    aren't given are the labels found; rows with a label outside of their axis are in no cell.
    """
    labelled = df.withColumns(dims)
    seen = labelled.groupBy(*dims).agg(*[e.alias(n) for n, e in values.items()])
    seen = seen.withColumns({n: missing_to_null(F.col(n)) for n in values})
    for d in dims:
        seen = seen.where(F.col(d).isNotNull() if d not in (axes or {}) else F.col(d).isin(list(axes[d])) if len(axes[d]) <= LITERAL_AXIS else F.lit(True))
    cube = Cube(lambda: densified(seen, cube), Axes(list(dims), axes or {}, lambda names: axis_labels(labelled, names)), tuple(values), chunks or {}, seen)
    for d, labels in (axes or {}).items():
        if len(labels) > LITERAL_AXIS:
            cube.seen = cube.seen.join(cube.axis_table(d).select(d), d, "left_semi")
    return cube


def densified(seen: DataFrame, cube: Cube) -> DataFrame:
    """All cells of the axes with what was seen of them.

    Cells are a distributed range of row-major numbers, so the grid is made in parallel whatever its size; what was seen
    meets it by one equi-join on that number.
    """
    sizes = cube.sizes
    numbered = cube.indexed(seen).select(row_major([(F.col(f"i_{d}"), n) for d, n in sizes.items()]).alias("_cell"), *cube.variables)
    return cube.grid(*cube.dims).join(numbered, "_cell", "left").select(*cube.index(), *cube.dims, *cube.variables)


def from_cells(df: DataFrame, dims: Sequence[str], chunks: dict[str, int] | None = None, axes: dict[str, Sequence] | None = None) -> Cube:
    """A cube of a table of cells that has i_<dim> and <dim> columns already (as written by sources.write_cube).

    Labels come from the cells when they are asked for, unless axes has them.
    """

    def load(names: list[str]) -> dict[str, list]:
        out = {}
        for d in names:
            rows = df.select(f"i_{d}", d).distinct().limit(MAX_AXIS + 1).collect()
            if len(rows) > MAX_AXIS:
                raise ValueError(f"axis {d} has more than {MAX_AXIS} labels; use a coarser one")
            out[d] = [r[1] for r in sorted(rows, key=lambda r: r[0])]
        return out

    skip = {*dims, *(f"i_{d}" for d in dims)}
    names = [c for c in df.columns if c not in skip]
    floats = {f.name: missing_to_null(F.col(f.name)) for f in df.schema if f.name in names and f.dataType.simpleString() in ("double", "float")}
    return Cube(df.withColumns(floats) if floats else df, Axes(list(dims), axes or {}, load), tuple(names), chunks or {})
