"""The number of paths between all nodes of a graph without cycles, as packed lists.

Nodes are numbered in their order, 2 ** 20 numbers a chunk. What a node reaches over paths of one
length is a row for each chunk: the places in it, as differences of seven bits a byte, and the counts
that aren't one. Nodes are dealt to parts. A round reads, part by part, the edges into a part's nodes
and these nodes' rows from files in the checkpoint folder, and sends the rows to the parts of the edges'
sources in packed messages; a part adds them up. So only messages are shuffled, only packed rows are
kept, and names come back as the result is read: a part's rows of all lengths are added up then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.sources.session import ensure_checkpoints

CHUNK_BITS = 20
#: Nodes in a range that is numbered by one task, edges of a part.
RANGE_NODES, PART_EDGES = 800_000, 1 << 20
#: So many edges, list entries or bytes are worked on at a time.
STEP = 1 << 20
#: Bytes of packed rows that are read at a time.
READ_STEP = 1 << 18
#: Bytes of rows held back to be sent in larger messages.
HELD = 24 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROWS = "part int, chunk long, place long, leaves binary, more binary, work double"
_ROW_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
_MESSAGES = "part int, chunk long, sub int, edges int, rows int, size int, body binary"
_MESSAGE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def places(numbers: np.ndarray) -> np.ndarray:
    """A node's place in the order of its part, which tells its number."""
    return (numbers.astype(np.uint64) * _ODD).view(np.int64)


def numbers(of: np.ndarray) -> np.ndarray:
    return (of.view(np.uint64) * _BACK).view(np.int64)


def put(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of so many values each, seven bits a byte."""
    values = values.astype(np.uint64)
    long = np.ones(len(values), dtype=np.int64)
    for j in range(1, 10):
        more = values >= np.uint64(1 << 7 * j) if 7 * j < 64 else np.zeros(0, bool)
        if not more.any():
            break
        long += more
    ends = np.cumsum(long)
    starts = ends - long
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for j in range(int(long.max()) if len(long) else 0):
        some = slice(None) if j == 0 else long > j
        byte = (values[some] >> np.uint64(7 * j)) & np.uint64(127)
        data[starts[some] + j] = byte.astype(np.uint8) | ((long[some] > j + 1).astype(np.uint8) << 7)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def get(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of so many bytes each, and how many values each has."""
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    long = ends - starts + 1
    values = (data[starts] & 127).astype(np.int64)
    for j in range(1, int(long.max()) if len(long) else 0):
        some = np.flatnonzero(long > j)
        values[some] |= (data[starts[some] + j] & 127).astype(np.int64) << (7 * j)
    before = np.concatenate([[0], np.cumsum(last)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values, before[bounds[1:]] - before[bounds[:-1]]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of lists, and how many each has."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, np.diff(bounds)


def entries(leaves: np.ndarray, sizes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' lists: places in the chunk, numbers of paths, and how many entries each row has."""
    values, counts = get(leaves, sizes)
    ways = np.ones(len(values), dtype=np.int64)
    ways[(values & 1).astype(bool)] = get(more, np.array([len(more)]))[0]
    steps = np.cumsum(values >> 1)
    first = np.cumsum(counts) - counts
    some = counts > 0
    start = np.zeros(len(counts), dtype=np.int64)
    start[some] = steps[first[some]] - (values[first[some]] >> 1)
    return steps - np.repeat(start, counts), ways, counts


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def added(place: np.ndarray, at: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each node and place in the chunk, in their order."""
    nodes, of = np.unique(place, return_inverse=True)
    key = of.reshape(-1) << CHUNK_BITS | at
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(starts):
        return place, at, ways
    ways = ways[order]
    if np.add.reduceat(ways.astype(np.float64), starts).max() >= 2.0**63:
        raise OverflowError("more paths between two nodes than a long holds, or a cycle")
    key = key[starts]
    return nodes[key >> CHUNK_BITS], key & ((1 << CHUNK_BITS) - 1), np.add.reduceat(ways, starts)


def packed(place: np.ndarray, at: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Rows of entries in order: nodes, their lists, and how many entries each has."""
    fresh = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.append(starts, len(place)))
    steps = np.diff(at, prepend=0)
    steps[starts] = at[starts]
    many = ways > 1
    so_many = np.add.reduceat(many, starts, dtype=np.int64) if len(starts) else starts
    return place[starts], put(steps << 1 | many, counts), put(ways[many], so_many), counts


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _files(folder: str, key: str) -> list[pq.ParquetFile]:
    from pyarrow import fs

    files, root = _filesystem(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/{key}", allow_not_found=True))
    return [pq.ParquetFile(files.open_input_file(f.path)) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]


def _column(folder: str, key: str, *names: str) -> list[pa.ChunkedArray] | None:
    found = [f.read(columns=list(names), use_threads=False) for f in _files(folder, key)]
    if not found:
        return None
    table = pa.concat_tables(found)
    return [table[n] for n in names]


def _rows(folder: str, part: int) -> Iterator[Iterator[pa.RecordBatch]]:
    """For each file of a part its rows, in pieces of about ``READ_STEP`` bytes."""
    for file in _files(folder, f"part={part}"):

        def pieces(file: pq.ParquetFile = file) -> Iterator[pa.RecordBatch]:
            groups = [file.metadata.row_group(i) for i in range(file.num_row_groups)]
            widest = max((g.total_byte_size // max(1, g.num_rows) for g in groups), default=0)
            at_once = min(8192, max(16, 4 * READ_STEP // (widest + 1)))
            for batch in file.iter_batches(batch_size=at_once, columns=["chunk", "place", "leaves", "more"], use_threads=False):
                size = np.cumsum(_bytes(batch.column(2))[1] + _bytes(batch.column(3))[1]) // READ_STEP
                cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        yield batch.slice(a, b - a)

        yield pieces()


def _long(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


class Sender:
    """Rows on their way to the parts of the edges' sources, held back until they make larger messages."""

    def __init__(self, sub_bits: int) -> None:
        self.sub_bits, self.held, self.size = sub_bits, [], 0

    def add(self, part: np.ndarray, src: np.ndarray, row: np.ndarray, chunk: np.ndarray, leaves: pa.Array, more: pa.Array) -> Iterator[pa.RecordBatch]:
        """Row number ``row`` for node ``src``, for each edge."""
        self.held.append((part, src, row, chunk, leaves, more))
        self.size += 16 * len(src) + leaves.nbytes + more.nbytes
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        base = np.cumsum([0, *(len(h[3]) for h in self.held)])
        part, src, chunk = (np.concatenate([h[i] for h in self.held]) for i in (0, 1, 3))
        row = np.concatenate([h[2] + b for h, b in zip(self.held, base[:-1], strict=True)])
        leaves, more = (pa.concat_arrays([h[i] for h in self.held]) for i in (4, 5))
        self.held, self.size = [], 0
        sub = (places(src).view(np.uint64) >> np.uint64(64 - self.sub_bits)).astype(np.int64) if self.sub_bits else np.zeros(len(src), np.int64)
        chunks = chunk[row]
        order = np.lexsort((src, row, sub, chunks, part))
        part, sub, chunks, src, row = part[order], sub[order], chunks[order], src[order], row[order]
        new = np.flatnonzero((part[1:] != part[:-1]) | (sub[1:] != sub[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        cuts = [0, *new.tolist(), len(src)]
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            fresh = np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]])
            one = pa.array(row[a:b][fresh])
            (data, sizes), (data_more, sizes_more) = _bytes(leaves.take(one)), _bytes(more.take(one))
            heads = [fresh.astype(np.uint8), src[a:b].view(np.uint8).reshape(-1, 8).T, sizes.astype(np.uint32), sizes_more.astype(np.uint32), data, data_more]
            body = b"".join(x.tobytes() for x in heads)
            out.append((int(part[a]), int(chunks[a]), int(sub[a]), b - a, len(one), len(body), pa.compress(body, "zstd", asbytes=True)))
            if len(out) == 512:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _MESSAGES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MESSAGE_TYPES, strict=True)], names=names)


def _edges_into(folder: str, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of destinations (in order), sources' parts and numbers, ``STEP`` edges at a time."""
    for file in _files(f"{folder}/edges", f"part={part}"):
        for batch in file.iter_batches(batch_size=STEP, columns=["dst", "src_part", "src"], use_threads=False):
            dst = places(_long(batch.column(0)))
            order = np.argsort(dst, kind="stable")
            yield dst[order], _long(batch.column(1))[order], _long(batch.column(2))[order]


def _send(folder: str, length: int, sub_bits: int):
    """For parts, the messages of a round: what their nodes reach over ``length`` edges, for the nodes one edge before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                sender = Sender(sub_bits)
                for dst, src_part, src in _edges_into(folder, part):
                    if not length:
                        nodes, row = np.unique(dst, return_inverse=True)
                        of = numbers(nodes)
                        leaves = put((of & ((1 << CHUNK_BITS) - 1)) << 1, np.ones(len(of), np.int64))
                        more = put(np.zeros(0, np.int64), np.zeros(len(of), np.int64))
                        yield from sender.add(src_part, src, row.reshape(-1), of >> CHUNK_BITS, leaves, more)
                        continue
                    for pieces in _rows(f"{folder}/{length}", part):
                        for piece in pieces:
                            node = _long(piece.column(1))
                            a, b = np.searchsorted(dst, node), np.searchsorted(dst, node, "right")
                            some = np.flatnonzero(b > a)
                            edge = spread(a[some], (b - a)[some])
                            if len(edge):
                                row = np.repeat(np.arange(len(some)), (b - a)[some])
                                leaves, more = (pa.concat_arrays([piece.column(i).take(pa.array(some)).cast(pa.binary())]) for i in (2, 3))
                                yield from sender.add(src_part[edge], src[edge], row, _long(piece.column(0))[some], leaves, more)
                yield from sender.flush()

    return run


def _opened(edges: int, rows: int, size: int, body: bytes) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    row = np.cumsum(data[:edges], dtype=np.int64) - 1
    at = 9 * edges
    src = np.ascontiguousarray(data[edges:at].reshape(8, edges).T).view(np.int64).reshape(-1)
    sizes = np.frombuffer(data[at : at + 4 * rows].tobytes(), np.uint32).astype(np.int64)
    at += 8 * rows
    cut = at + int(sizes.sum())
    return (places(src), row, *entries(data[at:cut], sizes, data[cut:]))


def _add_up(folder: str):
    """Messages, by part, chunk and hash of the node, to the rows of the parts' nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key, size = None, 0

        def less() -> None:
            nonlocal held, size
            held = [added(*(np.concatenate([h[i] for h in held]) for i in range(3)))]
            size = 0

        def out() -> pa.RecordBatch:
            less()
            part, chunk, _ = key
            node, leaves, more, counts = packed(*held[0])
            if part not in into:
                into.clear()
                ends = [np.unique(dst, return_counts=True) for dst, _, _ in _edges_into(folder, part)]
                into[part] = tuple(np.concatenate([e[i] for e in ends] or [np.zeros(0, np.int64)]) for i in (0, 1))
            work = np.zeros(len(node))
            dst, many = into[part]
            if len(dst):
                place = np.minimum(np.searchsorted(node, dst), len(node) - 1)
                hit = node[place] == dst
                np.add.at(work, place[hit], many[hit])
            columns = [np.full(len(node), part), np.full(len(node), chunk), node, leaves, more, work * counts]
            names = [x.split()[0] for x in _ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, _ROW_TYPES, strict=True)], names=names)

        for batch in batches:
            for part, chunk, sub, *message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and key != (part, chunk, sub):
                    yield out()
                    held, size = [], 0
                key = (part, chunk, sub)
                node, row, at, ways, counts = _opened(*message)
                first = np.cumsum(counts) - counts
                # edges by steps, so that a row that goes to many nodes isn't spread at once
                for edges in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(counts[row]) // STEP)) + 1):
                    of = spread(first[row[edges]], counts[row[edges]])
                    held.append((np.repeat(node[edges], counts[row[edges]]), at[of], ways[of]))
                    size += len(of)
                    if size >= 2 * STEP:
                        less()
        if key is not None:
            yield out()

    return run


def _merged(streams: list[Iterator[pa.RecordBatch]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk, nodes, places in the chunk and numbers of paths, from files in the order of chunks and nodes."""
    heads: list[tuple[Iterator, pa.RecordBatch]] = [(s, b) for s in streams if (b := next(s, None)) is not None]
    while heads:
        chunk = min(b.column(0)[0].as_py() for _, b in heads)
        some = [(_long(b.column(0)) == chunk).sum() if b.column(0)[0].as_py() == chunk else 0 for _, b in heads]
        last = min(b.column(1)[int(n) - 1].as_py() for (_, b), n in zip(heads, some, strict=True) if n)
        taken, rest = [], []
        for (s, b), n in zip(heads, some, strict=True):
            k = int(np.searchsorted(_long(b.column(1))[:n], last, "right"))
            if k:
                rows = b.slice(0, k)
                (leaves, sizes), (more, _) = _bytes(rows.column(2)), _bytes(rows.column(3))
                at, ways, counts = entries(leaves, sizes, more)
                taken.append((np.repeat(_long(rows.column(1)), counts), at, ways))
            b = b.slice(k) if k < b.num_rows else next(s, None)
            if b is not None:
                rest.append((s, b))
        heads = rest
        yield (chunk, *(taken[0] if len(taken) == 1 else added(*(np.concatenate([t[i] for t in taken]) for i in range(3)))))


def _read(folder: str, lengths: int, kind: pa.DataType):
    """For parts, all their nodes' paths by names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                found = _column(f"{folder}/roots", f"part={part}", "number", "id")
                if found is None:
                    continue
                place = places(_long(found[0]))
                order = np.argsort(place)
                place, roots = place[order], found[1].combine_chunks().cast(kind).take(pa.array(order))
                names, at_chunk = None, None
                for chunk, node, at, ways in _merged([s for n in range(1, lengths + 1) for s in _rows(f"{folder}/{n}", part)]):
                    if chunk != at_chunk:
                        of, leaves = _column(f"{folder}/names", f"chunk={chunk}", "number", "id")
                        names, at_chunk = leaves.combine_chunks().cast(kind).take(pa.array(np.argsort(_long(of)))), chunk
                    for a in range(0, len(node), STEP // 4):
                        b = a + STEP // 4
                        root = np.searchsorted(place, node[a:b])
                        yield pa.RecordBatch.from_arrays([roots.take(pa.array(root)), names.take(pa.array(at[a:b])), pa.array(ways[a:b])], names=["root", "leaf", "ways"])

    return run


class _Folder:
    """Tables in a folder of the checkpoint folder; a job's shuffles are dropped as it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{spark.sparkContext.getCheckpointDir()}/multiplicity-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{name}")
        finally:
            conf.unset(key) if before is None else conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def multiplicity(edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """``root``, ``leaf``, ``ways``: the number of paths from each node to each that it reaches, itself included.

    Repeated edges count each. A round for each length of paths. Cycles raise.
    """
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    folder = _Folder(spark)
    of = edges.schema["src"].dataType
    raw = folder.write(edges.select("src", F.col("dst").cast(of).alias("dst")), "raw")
    ids = raw.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    ids = folder.write(ids, "ids")
    n_nodes = ids.count()
    raw = raw.where("src is not null and dst is not null")
    parts = max(8, -(-raw.count() // PART_EDGES))
    ranges = max(1, -(-n_nodes // RANGE_NODES))
    nodes = ids.repartitionByRange(ranges, "id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("number"))
    nodes = folder.write(nodes, "nodes")
    folder.drop("ids")
    part = lambda c: F.pmod(F.hash(c), F.lit(parts))  # noqa: E731  (where repartition puts it)
    folder.write(nodes.withColumn("part", part("id")).repartition(parts, "id").sortWithinPartitions("part"), "roots", "part")
    chunks = nodes.withColumn("chunk", F.shiftright("number", CHUNK_BITS))
    folder.write(chunks.repartition(ranges, "chunk").sortWithinPartitions("chunk", "number"), "names", "chunk")
    numbered = raw.join(nodes.select(F.col("id").alias("src"), F.col("number")), "src").select(part("src").alias("src_part"), F.col("number").alias("src"), "dst")
    numbered = folder.write(numbered, "numbered")
    folder.drop("raw")
    into = numbered.repartition(parts, "dst").join(nodes.select(F.col("id").alias("dst"), "number").repartition(parts, "dst").hint("merge"), "dst")
    into = into.select(F.col("number").alias("dst"), "src_part", "src", part("dst").alias("part"))
    work = float(folder.write(into.sortWithinPartitions("part", "dst"), "edges", "part").count())
    folder.drop("numbered")

    tasks = spark.range(0, parts, 1, parts).select(F.col("id").cast("int").alias("part"))
    names = StructType([StructField("root", of), StructField("leaf", of), StructField("ways", LongType())])
    # no path without a cycle has more edges than there are nodes
    for length in range(min(most_levels, n_nodes) + 1):
        if not work:
            paths = tasks.mapInArrow(_read(folder.path, length, to_arrow_type(of)), names)
            return nodes.select(F.col("id").alias("root"), F.col("id").alias("leaf"), F.lit(1).cast("long").alias("ways")).unionByName(paths)
        sub_bits = max(0, int(work / parts / (2 * STEP))).bit_length()
        sent = tasks.mapInArrow(_send(folder.path, length, sub_bits), _MESSAGES)
        dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "chunk", "sub")
        rows = dealt.mapInArrow(_add_up(folder.path), _ROWS).sortWithinPartitions("part", "chunk", "place")
        work = folder.write(rows, f"{length + 1}", "part").agg(F.sum("work")).first()[0]
    raise ValueError("the graph has a cycle")

