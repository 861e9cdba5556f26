"""Files as documents, a labelled corpus, and the text report."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detector import NOTHING
from ..operators.models import Pack, builtin_pack
from ..operators.whole import PIECE, detect_whole
from ..plans.detect import detect, detect_lines
from ..shipping import ship

#: Kinds of files a labelled corpus is read from. Fixed values.
CORPUS_KINDS = ("html", "txt", "xml", "srt")
#: Labels of a labelled corpus that are known not to be supported. Fixed values.
CORPUS_SKIPPED = ("iso-8859-2", "iso-8859-6", "windows-1250", "windows-1254", "windows-1256")
_STATUS = re.compile(r"FileStatus\{path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?;", re.DOTALL)
_FILES = "path string, content binary"
_FOUND = "path string, encoding string, confidence double, language string"
_ANSWER = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("confidence", pa.float64()), ("language", pa.string())])


def listing(spark: SparkSession, path: str, recursive: bool = False) -> Iterator[tuple[str, int]]:
    """(path, length) of the files that a path or pattern names, of those in a folder, and of folders within.

    One call for each folder, as Spark's own listing makes; names with a leading _ or . are listed like others.
    """
    jvm, java = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(java)
    found = system.globStatus(place)
    if found is None or not len(found):
        raise FileNotFoundError(path)

    def told(statuses):
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(statuses)
        if "{path=null;" not in text:
            return [(name, folder == "true", int(length or 0)) for name, folder, length in _STATUS.findall(text)]
        # A mount table's statuses write nothing of the ones they stand for; each is asked.
        return [(x.getPath().toString(), x.isDirectory(), x.getLen()) for x in statuses]

    todo = [(told(found), True)]
    while todo:
        statuses, enter = todo.pop()
        for name, folder, length in statuses:
            if not folder:
                yield name, length
            elif enter or recursive:
                todo.append((told(system.listStatus(jvm.org.apache.hadoop.fs.Path(name))), False))


def _hidden(path: str) -> bool:
    """Whether Spark's readers pass over it: a name that begins with _ or a dot, on the way to it or its own."""
    return any(part[:1] in ("_", ".") and "=" not in part for part in path.split("/"))


def _open(path: str):
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    system, at = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    return system.open_input_stream(at)


def _read_each(batches):
    """Contents of files by their paths, one at a time."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as f:
                content = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])


def _kinds(spark: SparkSession, paths: tuple, recursive: bool) -> tuple[list, list, list, bool]:
    """Paths that hold files Spark's reader takes, files that it passes over by their names, empty files, and whether all are of a shared file system."""
    plain, hidden, empty, local = [], [], [], True
    for path in paths:
        some = False
        for name, length in listing(spark, path, recursive):
            local &= name.startswith("file:")
            if not length:
                empty.append(name)
            elif _hidden(name):
                hidden.append(name)
            else:
                some = True
        if some:
            plain.append(path)
    return plain, hidden, empty, local


def _reader(spark: SparkSession, paths: list, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)


def _dealt(spark: SparkSession, names: list) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "path string").repartition(min(spark.sparkContext.defaultParallelism, len(names)))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def read_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """(path, content) of each file, with ``recursive`` those of folders within too.

    Spark's reader takes most files. It passes over names with a leading _ or . and over empty files; the former are read by
    the workers, and the latter need no reading. Only paths of these two kinds pass through the driver. A file is a row, so
    ``spark.sql.sources.binaryFile.maxLength`` bounds its size.
    """
    ship(spark)
    plain, hidden, empty, _ = _kinds(spark, paths, recursive)
    parts = []
    if plain:
        parts.append(_reader(spark, plain, recursive).select("path", "content"))
    if hidden:
        parts.append(_dealt(spark, hidden).mapInArrow(_read_each, _FILES))
    if empty or not parts:
        parts.append(spark.createDataFrame([(x, bytearray()) for x in empty], _FILES))
    return _union(parts)


def _detect_each(pack: Pack, rename_legacy: bool):
    """Answers of files by their paths, or by their contents where a second column holds them; no more than a piece is copied."""

    def pieces(path):
        with _open(path) as f:
            while piece := f.read(PIECE):
                yield piece

    def run(batches):
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                if batch.num_columns == 1:
                    found = detect_whole(lambda path=path: pieces(path), pack, rename_legacy=rename_legacy)
                else:
                    content = memoryview(batch.column(1)[i].as_buffer())
                    found = detect_whole(lambda x=content: (bytes(x[at : at + PIECE]) for at in range(0, len(x), PIECE)), pack, rename_legacy=rename_legacy)
                yield pa.RecordBatch.from_pylist([dict(zip(_ANSWER.names, (path, *found), strict=True))], _ANSWER)

    return run


def detect_files(spark: SparkSession, *paths: str, rename_legacy: bool = False, recursive: bool = False, pack: Pack | None = None) -> DataFrame:
    """(path, encoding, confidence, language) of each file: the answer of one feed, without holding the file.

    Workers read files of a shared file system piece by piece, whatever their size, by paths that Spark lists. In other stores
    only Spark's reader is sure to find them: there a file is a row, bounded as in ``read_files``.
    """
    ship(spark)
    plain, hidden, empty, local = _kinds(spark, paths, recursive)
    run, parts = _detect_each(pack or builtin_pack(), rename_legacy), []
    if plain:
        parts.append(_reader(spark, plain, recursive).select("path", *([] if local else ["content"])).mapInArrow(run, _FOUND))
    if hidden:
        parts.append(_dealt(spark, hidden).mapInArrow(run, _FOUND))
    if empty or not parts:
        parts.append(spark.createDataFrame([(x, *NOTHING) for x in empty], _FOUND))
    return _union(parts)


def report(files: DataFrame, minimal: bool = False, rename_legacy: bool = False, name: str = "path", content: str = "content") -> DataFrame:
    """A line of text for each row, read line by line and no further than needed: (name, line).

    A null name is written as None; names may repeat. Null contents are empty.
    """
    bare = files.select(F.col(name).alias("name"), F.coalesce(F.col(content), F.lit(b"")).alias("content"))
    found = detect_lines(bare, rename_legacy=rename_legacy).select("name", "detected.*")
    if minimal:
        return found.select("name", F.coalesce("encoding", F.lit("None")).alias("line"))
    # A confidence is written as its shortest decimal form.
    written = F.coalesce("name", F.lit("None"))
    line = F.when(F.col("encoding").isNull(), F.concat(written, F.lit(": no result"))).otherwise(
        F.concat(written, F.lit(": "), "encoding", F.lit(" with confidence "), F.col("confidence").cast("string"))
    )
    return found.select("name", line.alias("line"))


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, expected, content): the folder's name, lower-cased, is the encoding; a language behind it is cut off.

    Files that lie in ``folder`` itself have no label.
    """
    bare_path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    top = re.sub(r"^(?:[a-z0-9]+:)?/*", "/", folder.rstrip("/"))
    files = read_files(spark, folder, recursive=True).where(F.regexp_replace(bare_path, r"/[^/]*$", "") != top)
    label = F.lower(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    # Labels such as iso-8859-7-greek end in a language's name.
    bare = F.regexp_replace(label, r"-(?:arabic|bulgarian|croatian|cyrillic|czech|danish|dutch|english|finnish|french|german|greek|hebrew|hungarian|italian|norwegian|polish|portuguese|romanian|russian|slovak|slovene|spanish|swedish|thai|turkish)$", "")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*CORPUS_KINDS)).select("path", bare.alias("expected"), "content")


def same_text(content: bytes, one: str | None, other: str | None, form: str = "NFKC") -> bool:
    """Whether two encodings read the content as the same text, by a normal form; what can't be read is empty."""

    def text(name):
        try:
            return unicodedata.normalize(form, content.decode(name or ""))
        except (LookupError, UnicodeError):
            return ""

    return text(one) == text(other)


def corpus_accuracy(spark: SparkSession, folder: str, rename_legacy: bool = False) -> DataFrame:
    """(expected, files, right) of a labelled corpus; labels of CORPUS_SKIPPED are left out.

    An answer is right if it is the label, whatever the case, or reads the file as the same text.
    """
    found = detect(labelled_corpus(spark, folder).where(~F.col("expected").isin(*CORPUS_SKIPPED)), rename_legacy=rename_legacy)
    form = "NFKD" if rename_legacy else "NFKC"

    def right(batches):
        for contents, names, labels in batches:
            yield pd.Series([(n or "").lower() == x or same_text(bytes(c), x, n, form) for c, n, x in zip(contents, names, labels)])

    right.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    judged = found.select("expected", F.pandas_udf(right, "boolean")("content", "detected.encoding", "expected").cast("int").alias("ok"))
    return judged.groupBy("expected").agg(F.count("*").alias("files"), F.sum("ok").alias("right"))
