"""Source trees as frames of files: scan, ignore rules, language, classification."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph import schema as s
from strandgraph.functions.paths import basename, extension
from strandgraph.functions.patterns import Ignore

# Languages by suffix, by whole name, and by interpreter.
BY_EXTENSION = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin",
    "pl": "perl", "pm": "perl", "sh": "bash", "bash": "bash", "toml": "toml", "yaml": "yaml", "yml": "yaml", "ini": "ini", "cfg": "ini", "service": "ini", "socket": "ini", "timer": "ini", "target": "ini",
    "mount": "ini", "path": "ini", "slice": "ini", "mk": "make", "mak": "make", "cmake": "cmake", "html": "html", "htm": "html", "dart": "dart",
}
BY_NAME = {"Makefile": "make", "makefile": "make", "GNUmakefile": "make", "CMakeLists.txt": "cmake"}
SHELLS = ("sh", "bash", "dash", "zsh", "ash")
TRACKED_DOT_DIRECTORIES = (".github", ".gitlab", ".circleci")
SHEBANG_BYTES = 512


def _mapped(key: Column, values: dict) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def language_of(path: Column, head: Column | None = None) -> Column:
    """Language by whole name, else suffix, else, without a suffix, by the
    interpreter that the first line (``head``) names."""
    name = basename(path)
    known = F.coalesce(_mapped(name, BY_NAME), F.when(name.contains("."), _mapped(extension(path), BY_EXTENSION)))
    if head is None:
        return known
    line = F.regexp_extract(head, r"^#!\s*([^\r\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    command = F.element_at(F.split(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), "/"), -1)
    rest = F.filter(F.slice(words, 2, 99), lambda w: ~w.startswith("-"))
    interpreter = F.when(command == "env", F.try_element_at(rest, F.lit(1))).otherwise(command)
    return F.coalesce(known, F.when(~name.contains(".") & interpreter.isin(*SHELLS), "bash"))


LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("uri", pa.string())])
#: Folders that the driver looks into, at most, before executors take the rest.
FOLDERS_FIRST = 64


def entries(top: str, folder: str) -> tuple[list[str], list[tuple]]:
    """(folders to follow, files) of one folder of the tree at ``top``. Links, hidden
    folders but the tracked ones, and the checksums that Hadoop keeps beside its own
    files are left out; what cannot be read is empty."""
    folders, files = [], []
    join = lambda name: f"{folder}/{name}" if folder else name
    follow = lambda name: not name.startswith(".") or name in TRACKED_DOT_DIRECTORIES
    if top.startswith("file:"):
        local = re.sub("^file:/+", "/", top)
        try:
            with os.scandir(f"{local}/{folder}") as found:
                for e in found:
                    if e.is_symlink() or e.name.startswith(".") and e.name.endswith(".crc"):
                        continue
                    if e.is_dir():
                        folders += [join(e.name)] if follow(e.name) else []
                    elif e.is_file():
                        st = e.stat()
                        files.append((join(e.name), st.st_size, st.st_mtime_ns, f"{top}/{join(e.name)}"))
        except OSError:
            pass
        return folders, files
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{top}/{folder}" if folder else top)
    for e in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if e.type == fs.FileType.Directory:
            folders += [join(e.base_name)] if follow(e.base_name) else []
        elif e.type == fs.FileType.File:
            files.append((join(e.base_name), e.size, e.mtime_ns or 0, f"{top}/{join(e.base_name)}"))
    return folders, files


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ns, uri) of all files below ``root``. The driver looks
    for the first folders only; executors list the files of these and what is
    below the others, so the names of a large tree do not pass the driver."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/")
    if not fs.exists(base):
        raise s.GraphError("path_not_found", f"no folder '{root}'")
    todo, seen = [""], []
    while todo and len(seen) < FOLDERS_FIRST and len(todo) < FOLDERS_FIRST:
        seen.append(todo.pop(0))
        todo += entries(top, seen[-1])[0]
    ddl = "path string, size long, mtime_ns long, uri string"

    def run(batches):
        for b in batches:
            stack = list(zip(b.column("folder").to_pylist(), b.column("below").to_pylist()))
            while stack:
                folder, below = stack.pop()
                folders, files = entries(top, folder)
                stack += [(x, True) for x in folders] if below else []
                if files:
                    yield pa.RecordBatch.from_pylist([dict(zip(LISTED.names, f)) for f in files], LISTED)

    asked = spark.createDataFrame([(x, False) for x in seen] + [(x, True) for x in todo], "folder string, below boolean")
    tasks = min(len(seen) + len(todo), 4 * spark.sparkContext.defaultParallelism)
    return asked.repartition(tasks).mapInArrow(run, ddl).checkpoint()


def dealt(df: DataFrame, key) -> DataFrame:
    """``df`` in two parts a core: rows that stand for files are small, and Spark
    would join a whole tree of them into one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def with_content(tree: DataFrame) -> DataFrame:
    """``tree`` with ``content``, read by the executors; null where a file is
    over the limit or cannot be read."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            out = []
            for uri, size in zip(b.column("uri").to_pylist(), b.column("size").to_pylist()):
                try:
                    if size > s.MAX_FILE_BYTES:
                        out.append(None)
                    elif uri.startswith("file:"):
                        with open(re.sub("^file:/+", "/", uri), "rb") as f:
                            out.append(f.read())
                    else:
                        system, path = fs.FileSystem.from_uri(uri)
                        with system.open_input_stream(path) as f:
                            out.append(f.read())
                except OSError:
                    out.append(None)
            yield from pa.Table.from_batches([b]).append_column("content", pa.array(out, pa.binary())).to_batches()

    tree = tree.drop("content")
    return dealt(tree, F.xxhash64("path")).mapInArrow(run, tree.selectExpr("*", "cast(null as binary) as content").schema)


def outer_rules(spark: SparkSession, root: str, out: Ignore) -> None:
    """Rules from outside a tree's own files: the user's global ones, and the
    repository's info/exclude, which count before all others."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    local = base.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    for at in ([f"file:{home}/git/ignore"] if local else []) + [f"{root.rstrip('/')}/.git/info/exclude"]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).getLen() < s.MAX_FILE_BYTES:
            stream = fs.open(path)
            try:
                out.add(bytes(stream.readAllBytes()).decode("utf-8", "replace"), "")
            finally:
                stream.close()


def ignore_rules(tree: DataFrame, root: str | None = None) -> Ignore:
    """Rules of the tree's .gitignore and .ignore files, outer folders first,
    after those from outside where ``root`` is given. Only those small files
    reach the driver."""
    own = tree.where(basename(F.col("path")).isin(".gitignore", ".ignore") & (F.col("size") < s.MAX_FILE_BYTES))
    out = Ignore()
    if root is not None:
        outer_rules(tree.sparkSession, root, out)
    rows = [r for r in with_content(own).select("path", "content").collect() if r["content"] is not None]
    for r in sorted(rows, key=lambda r: (r["path"].count("/"), r["path"])):
        out.add(bytes(r["content"]).decode("utf-8", "replace"), r["path"].rpartition("/")[0])
    return out


def candidates(tree: DataFrame, rules: Ignore | None = None) -> DataFrame:
    """The files that an index looks at: not ignored, not in dot folders but
    the tracked ones, no ignore files."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.startswith(".") & ~p.isin(*TRACKED_DOT_DIRECTORIES))
    name = basename(F.col("path"))
    out = tree.where(~hidden & ~(name.startswith(".") & name.endswith("ignore")))
    if rules is None or not rules.rules:
        return out

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not rules.excluded(p) for p in b.column("path").to_pylist()], pa.bool_()))

    kept = out.select("path").mapInArrow(run, "path string")
    return out.join(kept, "path", "left_semi")


def classified(tree: DataFrame) -> DataFrame:
    """``tree`` as files: path, hash, size, language, status, reason, detail,
    mtime_ns, and text of those that can be parsed. Checks in order: too
    large, unreadable, binary, no language, not UTF-8."""
    c = F.col("content")
    head = F.decode(F.substring(c, 1, SHEBANG_BYTES), "ISO-8859-1")
    valid = F.is_valid_utf8(c.cast("string"))
    language = language_of(F.col("path"), head)
    reason = (
        F.when(F.col("size") > s.MAX_FILE_BYTES, "oversized")
        .when(c.isNull(), "read_error")
        .when(F.locate("\u0000", F.decode(F.substring(c, 1, s.BINARY_WINDOW), "ISO-8859-1")) > 0, "binary")
        .when(language.isNull(), "unsupported_language")
        .when(~valid, "binary")
    )
    return tree.select(
        "path", F.sha2(c, 256).alias("hash"), "size", language.alias("language"), F.when(reason.isNull(), "indexed").otherwise("skipped").alias("status"), reason.alias("reason"),
        F.lit(None).cast("string").alias("detail"), "mtime_ns", F.when(reason.isNull(), c.cast("string")).alias("text"),
    )


def safe_relative(path: str, root: str | None = None) -> str:
    """``path`` if it stays below a root; absolute paths and ".." do not, nor, where
    ``root`` is a local folder, do links whose target is outside of it."""
    if path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path) or ".." in path.split("/"):
        raise s.GraphError("path_escape", "paths are relative to the project and stay in it")
    if root is not None and (root.startswith("/") or root.startswith("file:")):
        top = os.path.realpath(re.sub("^file:/+", "/", root))
        if os.path.commonpath([top, os.path.realpath(os.path.join(top, path))]) != top:
            raise s.GraphError("path_escape", "the path is a link to a place outside of the project")
    return path
