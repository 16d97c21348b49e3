"""Finding the files of a model."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path, PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmill.session import shared_folder

# Where a model directory keeps its files, and the variable that names one.
MODEL_FILES = ("onnx/model.onnx", "model.onnx")
VOCABULARY_FILE = "vocab.txt"
DIRECTORY_VARIABLE = "EMBEDDING_MODEL_PATH"


_sent: set[tuple[str, str]] = set()


def _is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def model_directory(given: str | None = None) -> Path | str:
    """The directory given, else the one named by the environment: a local folder, or a URI that Spark reads."""
    directory = str(given or os.environ.get(DIRECTORY_VARIABLE) or "")
    if not directory:
        raise ValueError(f"name a model directory or set {DIRECTORY_VARIABLE}")
    return directory.rstrip("/") if _is_uri(directory) else Path(directory)


def _below(directory: Path | str, name: str) -> Path | str:
    return directory / name if isinstance(directory, Path) else f"{directory}/{name}"


LARGEST_VALUE = 2**31 - 1 - 64  # Bytes that a column's value can have.


def _remote_facts(spark: SparkSession, path: str):
    """Length and time of a file that Spark reads, None if there is none; its content is not opened."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").head()
    except AnalysisException:
        return None


def _remote_digest(spark: SparkSession, path: str) -> str:
    """A digest taken by an executor: of the content, or of name, length and time if no value can hold the content."""
    facts = _remote_facts(spark, path)
    if facts.length > LARGEST_VALUE:
        return hashlib.sha256(f"{facts.path}|{facts.length}|{facts.modificationTime}".encode()).hexdigest()
    content = spark.read.format("binaryFile").load(path)
    return content.select(F.sha2("content", 256).alias("digest")).head().digest


def model_file(directory: str | None = None, spark: SparkSession | None = None) -> Path | str:
    """The first model file that exists; URIs need the session."""
    candidates = [_below(model_directory(directory), name) for name in MODEL_FILES]
    for candidate in candidates:
        if candidate.exists() if isinstance(candidate, Path) else _remote_facts(spark, candidate) is not None:
            return candidate
    raise FileNotFoundError("no model file; looked for " + ", ".join(map(str, candidates)))


def vocabulary_file(directory: str | None = None) -> Path | str:
    return _below(model_directory(directory), VOCABULARY_FILE)


def shared_vocabulary(spark: SparkSession, directory: str | None = None) -> str:
    """A path of the vocabulary that every executor can read: a local file is copied to the shared folder."""
    path = vocabulary_file(directory)
    if not isinstance(path, Path):
        return path
    content = path.read_bytes().decode("utf-8", "replace")
    copy = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    spark.createDataFrame([(content.removesuffix("\n"),)], "value string").coalesce(1).write.text(copy)
    return copy


def send_model(spark: SparkSession, directory: str | None = None) -> str:
    """Make the model file known to all executors under a name of its content; returns what an ``OnnxEncoder`` takes.

    A local file is sent by the driver. A URI is fetched by each executor itself (an archive that cannot be unpacked
    is a file under the name asked for), so a model's bytes are in no memory of the driver.
    """
    path, context = model_file(directory, spark), spark.sparkContext
    if isinstance(path, Path):
        with path.open("rb") as file:
            digest = hashlib.file_digest(file, "sha256").hexdigest()
    else:
        digest = _remote_digest(spark, path)
    name = f"{digest[:16]}-{PurePosixPath(str(path)).name}"
    if (context.applicationId, name) not in _sent:
        if isinstance(path, Path):
            named = Path(tempfile.mkdtemp(prefix="glyphmill-")) / name
            shutil.copyfile(path, named)
            context.addFile(str(named))
        else:
            context.addArchive(f"{path}#{name}")
        _sent.add((context.applicationId, name))
    return name
