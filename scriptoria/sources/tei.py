"""TEI XML files to a node table, and the metadata of their headers.

The only Python is the tokeniser of one file (XML cannot be split); what the
nodes mean is worked out relationally.  Positions count start tags, texts and
end tags of a file, so an element is the interval [node_seq, end_seq].
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.strings import clean_title, strip
from scriptoria.schemas import NODES
from scriptoria.session import stored_columns

# --- fixed value: catalogue file that is no text ---------------------------------
CATALOGUE_FILE = "__cts__.xml"
# ----------------------------------------------------------------------------------
_ROWS_PER_BATCH = 50_000
# Small files share a batch until their texts have this many bytes or characters.
_TEXT_PER_BATCH = 1 << 20
# Positions of a file that elements and the texts inside them meet by.
TILE = 64


def read_files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """XML files below a folder as file, xml (bytes)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name != CATALOGUE_FILE).select(F.col("path").alias("file"), F.col("content").alias("xml"))


def _nodes_of(file: str, xml: bytes | str, within: str | None = None) -> Iterator[tuple]:
    """Rows of one file in the order in which the elements end.

    With ``within`` only those of the elements of that tag, of what lies in them, and of the root.
    """
    rows: list[tuple] = []
    stack: list[tuple] = []
    pending: list[str] = []
    position = 0
    # How many elements of the tag are open; all counts where no tag is asked for.
    around = within is None

    def flush() -> None:
        nonlocal position
        if pending:
            position += 1
            parent = stack[-1][0] if stack else None
            if around:
                rows.append((file, position, position, parent, len(stack), "text", None, None, "".join(pending), None))
            pending.clear()

    def start(tag, attributes) -> None:
        nonlocal position, around
        flush()
        position += 1
        around += tag == within
        stack.append((position, tag, attributes))

    def end(_tag) -> None:
        nonlocal position, around
        flush()
        position += 1
        seq, tag, attributes = stack.pop()
        parent = stack[-1][0] if stack else None
        if around or not stack:
            rows.append((file, seq, position, parent, len(stack), "element", tag, attributes, None, None))
        around -= tag == within

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.UseForeignDTD(True)
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = pending.append
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as error:
        yield (file, 0, 0, None, 0, "error", None, None, None, str(error))
        return
    yield from rows


def _attribute_maps(lists: Sequence[list | None]) -> pa.MapArray:
    """Attributes as expat lists them, name after name with its value; None has no map."""
    flat = [x for own in lists if own for x in own]
    ends = np.cumsum([0] + [len(own) // 2 if own else 0 for own in lists])
    mask = np.array([own is None for own in lists] + [False])
    offsets = pa.array(ends, pa.int32(), mask=mask)
    return pa.MapArray.from_arrays(offsets, pa.array(flat[::2], pa.string()), pa.array(flat[1::2], pa.string()))


def parse_nodes(files: DataFrame, within: str | None = None) -> DataFrame:
    """Node table of the files (``file``, ``xml``); a file that is not well formed gives one row with ``error``.

    Every file is read whole.  ``within`` leaves out the rows that lie outside
    the elements of that tag, except the root's, for readers of one part of a file.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in NODES])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [_attribute_maps(c) if pa.types.is_map(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            # One file at a time: a batch of large files never exists twice.
            for file, xml in zip(batch.column(0), batch.column(1)):
                text = xml.as_py()
                found = _nodes_of(file.as_py(), text, within)
                while part := list(islice(found, _ROWS_PER_BATCH - len(rows))):
                    rows += part
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                held += len(text)
                if rows and held >= _TEXT_PER_BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("file", "xml").mapInArrow(run, NODES)


def map_files(files: DataFrame, hook, schema) -> DataFrame:
    """Run a Python hook per file; it yields rows as tuples in the order of the schema."""
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for file, xml in zip(batch["file"], batch["xml"]):
                yield pd.DataFrame(list(hook(file, xml)), columns=names)

    return files.select("file", "xml").mapInPandas(run, schema)


def failed_files(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "error").select("file", "error")


def import_counts(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Files imported and failed, from an ``error`` column."""
    return files.groupBy(*keys).agg(
        F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )


def file_results(nodes: DataFrame) -> DataFrame:
    """One row per file with its error, if any."""
    return nodes.groupBy("file").agg(F.max("error").alias("error"))


# Parts of the node table -----------------------------------------------------------


def inside(nodes: DataFrame, tag: str) -> DataFrame:
    """Nodes within the first element of the given tag in each file."""
    roots = (
        nodes.where(F.col("tag") == tag)
        .groupBy("file")
        .agg(F.min(F.struct("node_seq", "end_seq")).alias("__r"))
        .select("file", F.col("__r.node_seq").alias("__from"), F.col("__r.end_seq").alias("__to"))
    )
    return nodes.join(roots, "file").where(
        (F.col("node_seq") > F.col("__from")) & (F.col("node_seq") < F.col("__to"))
    ).drop("__from", "__to")


def element_text(nodes: DataFrame, elements: DataFrame, recurse: bool = False, separator: str = "") -> DataFrame:
    """Add ``text`` to elements: their direct text nodes, or all texts inside them.

    Direct texts are met by the parent's position.  For all texts a file is cut
    into tiles of ``TILE`` positions: an element stands under the tiles of its
    interval and a text under its one tile, so a text meets the few elements
    that reach into its tile and not all of its file.
    """
    texts = nodes.where(F.col("kind") == "text").select(
        F.col("file"), F.col("node_seq").alias("__at"), F.col("parent_seq").alias("__parent"), F.col("text").alias("__text")
    )
    wanted = elements.select("file", "node_seq", "end_seq")
    if recurse:
        tile = lambda c: F.floor(F.col(c) / TILE).cast("bigint")
        tiled = wanted.withColumn("__tile", F.explode(F.sequence(tile("node_seq"), tile("end_seq"))))
        pairs = tiled.join(texts.withColumn("__tile", tile("__at")), ["file", "__tile"]).where(F.col("__at").between(F.col("node_seq"), F.col("end_seq")))
    else:
        pairs = wanted.join(texts.withColumnRenamed("__parent", "node_seq"), ["file", "node_seq"])
    folded = pairs.groupBy("file", "node_seq").agg(F.array_sort(F.collect_list(F.struct("__at", "__text"))).alias("__t"))
    joined = folded.select("file", "node_seq", F.array_join(F.transform("__t", lambda t: t["__text"]), separator).alias("text"))
    return elements.drop("text").join(joined, ["file", "node_seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _first_text(nodes: DataFrame, elements: DataFrame, name: str, recurse: bool = False) -> DataFrame:
    with_text = element_text(nodes, elements, recurse)
    return with_text.groupBy("file").agg(F.min(F.struct("node_seq", "text")).alias("__f")).select("file", F.col("__f.text").alias(name))


def header_metadata(nodes: DataFrame) -> DataFrame:
    """Language, title, author and editors of each file.

    The author is sought in the first ``biblStruct``, then in the whole header;
    titles of type "sub" do not count; an editor entry is cut at "and".  The
    nodes of the headers are stored: each part of a header is a reader of its own.
    """
    header = stored_columns(inside(nodes, "teiHeader").select("file", "node_seq", "end_seq", "parent_seq", "kind", "tag", "attrs", "text"))
    tag = F.col("tag")
    language = _first_text(header, header.where(tag == "language"), "language")
    title = _first_text(
        header, header.where((tag == "title") & (F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("")) != "sub")), "title", recurse=True
    )
    citation = inside(header, "biblStruct")
    from_citation = _first_text(citation, citation.where(tag == "author"), "__cited")
    from_header = _first_text(header, header.where(tag == "author"), "__headed")
    pieces = F.split("text", "and")
    names = F.when(F.size(pieces) > 1, F.transform(pieces, strip)).otherwise(F.array("text"))
    editors = (
        element_text(header, header.where(tag == "editor"))
        .select("file", "node_seq", F.posexplode(names).alias("__pos", "name"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("node_seq", "__pos", "name"))).alias("__e"))
        .select("file", F.transform("__e", lambda e: e["name"]).alias("editors"))
    )
    step = (
        header.where(tag == "step").groupBy("file").agg(F.min(F.struct("node_seq", F.try_element_at("attrs", F.lit("refunit")).alias("refunit"))).alias("__s"))
        .select("file", (F.coalesce(F.col("__s.refunit"), F.lit("")) == "line").alias("numbers_lines"))
    )
    out = nodes.where(F.col("kind") != "error").select("file").distinct()
    for part in (language, title, from_citation, from_header, editors, step):
        out = out.join(part, "file", "left")
    return out.select(
        "file", strip(F.col("language")).alias("language"), clean_title(F.col("title")).alias("title"),
        F.coalesce("__cited", "__headed").alias("author"), "editors", F.coalesce("numbers_lines", F.lit(False)).alias("numbers_lines"),
    )


def state_sets(nodes: DataFrame) -> DataFrame:
    """Declared units: file, set_no (0-based), level (1-based in the set), merged_level, unit, section_type."""
    declared = inside(nodes, "encodingDesc").where(F.col("tag").isin("refsDecl", "state"))
    along = Window.partitionBy("file").orderBy("node_seq").rowsBetween(Window.unboundedPreceding, 0)
    is_set = F.col("tag") == "refsDecl"
    placed = declared.select(
        "file", "node_seq", "tag",
        F.try_element_at("attrs", F.lit("unit")).alias("unit"), F.try_element_at("attrs", F.lit("n")).alias("section_type"),
        (F.sum(is_set.cast("int")).over(along) - 1).alias("set_no"),
        F.sum((~is_set).cast("int")).over(along).alias("merged_level"),
    )
    in_set = Window.partitionBy("file", "set_no").orderBy("node_seq")
    return placed.where(F.col("tag") == "state").select(
        "file", "set_no", F.row_number().over(in_set).alias("level"), F.col("merged_level").cast("int").alias("merged_level"), "unit", "section_type"
    )


def chosen_states(states: DataFrame, parameters: DataFrame) -> DataFrame:
    """States of the set each file's parameters name ("*": all sets merged), folded to one array per file."""
    merged = F.coalesce("state_set", F.lit("0")) == "*"
    picked = states.join(parameters.select("file", "state_set"), "file").where(
        merged | (F.col("set_no").cast("string") == F.coalesce("state_set", F.lit("0")))
    )
    level = F.when(merged, F.col("merged_level")).otherwise(F.col("level"))
    return picked.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct(level.alias("level"), F.col("unit").alias("name"), "section_type"))).alias("states")
    )


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))
