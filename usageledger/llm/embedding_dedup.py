"""Embedding near-duplicates: product quantisation with inverted lists.

Coarse centroids cut the vectors of a label into lists; a vector's residual to its
centroid is stored as one code per subspace.  A query visits every list that can
hold a neighbour, estimates distances with per-subspace tables, and confirms what
may be near enough by the exact cosine.

Vectors of different lengths have nothing in common: each length has a quantiser of
its own.  Both tests are exact bounds, so no pair is lost: a neighbour within distance r lies
behind the plane between two centroids by at most r, and a true distance differs
from the estimate by at most the member's own quantisation error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageledger.llm.components import components
from usageledger.llm.shipping import map_arrow, ship
from usageledger.session import materialize

LEAST_COSINE = 0.93
SAMPLE_ROWS = 20_000
ROWS_PER_LIST = 1_024
SAMPLES_PER_LIST = 16
SUBSPACES = 16
CODES = 64
BLOCK_ROWS = 1_024
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = _squares(x[a : a + 4096], centres).argmin(axis=1)
    return out


@dataclass
class Quantiser:
    """For vectors of one length: centroids of each label that has several lists, and
    the residual code books.  A label without an entry has one list around the origin."""

    width: int
    centroids: dict[int, np.ndarray]
    books: list[np.ndarray]
    parts: list[slice] = field(default_factory=list)

    def of(self, label: int) -> np.ndarray:
        return self.centroids.get(label, np.zeros((1, self.width)))

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation error of residuals."""
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(residual - self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def estimate(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to members, by table lookup."""
        total = np.zeros((len(residual), len(codes)))
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            total += _squares(residual[:, p], book)[:, codes[:, m]]
        return np.sqrt(total)


def fit(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, Quantiser]:
    """Fit on up to ``sample_rows`` unit vectors, by the order of a hash of the id; one
    quantiser for each length among them.  A label gets one list for every
    ``ROWS_PER_LIST`` of its vectors of a length, as far as the sample has
    ``SAMPLES_PER_LIST`` vectors for each."""
    chosen = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows)
    rows = chosen.select("label", "embedding").collect()
    by_width: dict[int, list] = {}
    for row in rows:
        by_width.setdefault(len(row["embedding"]), []).append(row)
    labels = {width: np.array([r["label"] for r in own]) for width, own in by_width.items()}
    large: dict[int, dict[int, int]] = {}
    for width, own in labels.items():
        counted = zip(*np.unique(own, return_counts=True))
        large[width] = {int(v): int(c) for v, c in counted if c >= 2 * SAMPLES_PER_LIST}
    wanted = {label for own in large.values() for label in own}
    sizes = {}
    if wanted:  # at most sample_rows / 32 labels, as many lengths
        size = F.size("embedding")
        known = vectors.where(F.col("label").isin(list(wanted)) & size.isin([w for w, own in large.items() if own]))
        counted = known.groupBy("label", size.alias("width")).count().collect()
        sizes = {(r["width"], r["label"]): r["count"] for r in counted}
    models = {}
    for width, own_rows in by_width.items():
        x = np.array([r["embedding"] for r in own_rows], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        model = models[width] = Quantiser(width, {}, [])
        residual = x.copy()
        for label, count in large[width].items():
            lists = min(math.ceil(sizes[width, label] / ROWS_PER_LIST), count // SAMPLES_PER_LIST)
            if lists > 1:
                own = labels[width] == label
                model.centroids[label] = _kmeans(x[own], lists)
                centres = model.centroids[label]
                residual[own] -= centres[_nearest(x[own], centres)]
        cuts = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
        model.parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        codes = min(CODES, len(x))
        model.books = [_kmeans(residual[:, p], codes) for p in model.parts]
    return models


def _model(models: dict[int, Quantiser], width: int) -> Quantiser:
    """The quantiser of a length.  One that the sample has missed has a single list and
    a single code, so that all its vectors are compared."""
    return models.get(width) or Quantiser(width, {}, [np.zeros((1, width))], [slice(0, width)])


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


_ROUTED = (
    "label int, width int, list int, home boolean, rep long, copies long, embedding array<float>, codes binary, error double"
)


def _route(models: dict[int, Quantiser], radius: float):
    """A row for every list that a vector has to visit; the one for its own list is
    the index entry, with codes and quantisation error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                label = part.column("label").to_numpy(zero_copy_only=False)
                widths = pc.list_value_length(part.column("embedding")).to_numpy(zero_copy_only=False)
                row, place, home, codes, error = [], [], [], [], []
                for width, value in np.unique(np.stack([widths, label], axis=1), axis=0):
                    at = np.flatnonzero((label == value) & (widths == width))
                    model = _model(models, int(width))
                    x = _unit(part.column("embedding").take(pa.array(at)))
                    centres = model.of(int(value))
                    square = _squares(x, centres)
                    nearest = square.argmin(axis=1)
                    gap = square - square[np.arange(len(at)), nearest][:, None]
                    between = np.sqrt(_squares(centres, centres))[nearest]
                    i, j = np.nonzero(gap <= 2 * radius * between + _SLACK)
                    code, far = model.encode(x - centres[nearest])
                    row.append(at[i])
                    place.append(j)
                    home.append(nearest[i] == j)
                    codes += [code[k].tobytes() if own else None for k, own in zip(i, home[-1])]
                    error.append(far[i])
                row = np.concatenate(row)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken.column("label"),
                        pa.array(widths[row].astype(np.int32)),
                        pa.array(np.concatenate(place).astype(np.int32)),
                        pa.array(np.concatenate(home)),
                        taken.column("rep"),
                        taken.column("copies"),
                        taken.column("embedding"),
                        pa.array(codes, pa.binary()),
                        pa.array(np.concatenate(error)),
                    ],
                    names=[part.split()[0] for part in _ROUTED.split(", ")],
                )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that connect all that the given links connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _compare(models: dict[int, Quantiser], least: float, radius: float):
    """Links of a block of queries with a block of members: one count for each query,
    and only the links that are needed to connect."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        member = table.column("member").to_numpy()
        x_rows, q_rows = (table.filter(pa.array(m)).combine_chunks() for m in (member, ~member))
        empty = np.empty(0, np.int64)
        rep, links, one, two = empty, empty, empty, empty
        if len(x_rows) and len(q_rows):
            model = _model(models, table.column("width")[0].as_py())
            centre = model.of(table.column("label")[0].as_py())[table.column("list")[0].as_py()]
            x = _unit(x_rows.column("embedding").combine_chunks())
            q = _unit(q_rows.column("embedding").combine_chunks())
            codes = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in x_rows.column("codes")])
            error = x_rows.column("error").to_numpy()
            i, j = np.nonzero(model.estimate(q - centre, codes) <= radius + error[None, :] + _SLACK)
            ids, own = (rows.column("rep").to_numpy() for rows in (q_rows, x_rows))
            other = ids[i] != own[j]
            i, j = i[other], j[other]
            near = np.concatenate(
                [np.einsum("ij,ij->i", q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)]
                or [np.empty(0)]
            )
            i, j = i[near >= least], j[near >= least]
            links = np.bincount(i, x_rows.column("copies").to_numpy()[j], len(ids)).astype(np.int64)
            rep, links = ids[links > 0], links[links > 0]
            kept = _forest(ids[i], own[j])
            one, two = ids[i[kept]], own[j[kept]]
        none = pa.nulls(len(rep), pa.int64())
        return pa.table(
            {
                "rep": pa.array(np.r_[rep, one]),
                "links": pa.array(np.r_[links, np.zeros(len(one), np.int64)]),
                "other": pa.concat_arrays([none, pa.array(two)]),
            }
        )

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id,
    embedding, label).

    Vectors link if their labels and lengths are equal and their cosine is at least ``least``
    (up to rounding in double precision); equal vectors of one label are one class
    and link with each other.  A vector that is null, zero, or holds a null or a
    non-finite number, a null label and a null vec_id link with nothing; a null
    vec_id has no component_id and is kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    radius = math.sqrt(2 - 2 * least)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("int"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # Two chains of hashes from different starts name a class of equal vectors.
    rows = rows.withColumn("name", F.when(usable, F.xxhash64("label", "embedding"))).withColumn(
        "mark", F.when(usable, F.xxhash64(F.lit("mark"), "embedding"))
    )
    classes = materialize(
        rows.where("name IS NOT NULL")
        .groupBy("label", "name", "mark")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("copies"),
            F.any_value("embedding").alias("embedding"),
        ),
        "vectors",
    )
    models = fit(classes)
    if not models:
        found = spark.createDataFrame([], "rep long, links long, other long")
    else:
        routed = materialize(
            classes.select("label", "rep", "copies", "embedding").transform(map_arrow, _route(models, radius), _ROUTED),
            "lists",
        )
        sizes = routed.groupBy("label", "width", "list").agg(
            F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("member_blocks"),
            F.ceil(F.count("*") / (4 * BLOCK_ROWS)).cast("int").alias("query_blocks"),
        )
        sized = routed.join(sizes.where("member_blocks > 0"), ["label", "width", "list"])
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        one_of = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
        carried = ["label", "width", "list", "rep", "copies", "embedding", "codes", "error"]
        members = sized.where("home").select(
            *carried, F.lit(True).alias("member"), one_of("member_blocks").alias("x"), every("query_blocks").alias("y")
        )
        queries = sized.select(
            *carried, F.lit(False).alias("member"), every("member_blocks").alias("x"), one_of("query_blocks").alias("y")
        )
        found = (
            members.unionByName(queries.select(members.columns))
            .groupBy("label", "width", "list", "x", "y")
            .applyInArrow(_compare(models, least, radius), "rep long, links long, other long")
        )
    found = materialize(found, "found")
    joined = components(found.where("other IS NOT NULL"), "rep", "other")
    counted = (
        classes.select("label", "name", "mark", "rep", "copies")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "name",
            "mark",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    return (
        rows.select("vec_id", "label", "name", "mark")
        .join(counted, ["label", "name", "mark"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
