"""One registered query for each language: small sources made from every document,
and the facts that they hold, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.extract.files import extracted, facts
from strandgraph.sources import views

#: language: (ending, text, facts), {i} for the document's number. Facts are (kind,
#: name, place, line): definitions by label with their qualified name, calls with
#: their caller, imports, relations by edge type with the subtype, and routes by
#: method with the handler.
SOURCES = {
    "python": ("py", (
        "from lib.m{i} import x\n"
        "class A{i}(B):\n"
        "    def run(self):\n"
        "        return help_{i}(self.go())\n"
        "\n"
        "@app.get('/p/{i}')\n"
        "def top_{i}():\n"
        "    pass\n"
    ), [
        ("Class", "A{i}", "d.f{i}.A{i}", 2), ("Method", "run", "d.f{i}.A{i}.run", 3), ("Function", "top_{i}", "d.f{i}.top_{i}", 7),
        ("call", "help_{i}", "d.f{i}.A{i}.run", 4), ("call", "go", "d.f{i}.A{i}.run", 4), ("call", "get", "d.f{i}", 6), ("import", "lib.m{i}", "", 1),
        ("INHERITS", "B", "d.f{i}.A{i}", 2), ("GET", "/p/{i}", "top_{i}", 6),
    ]),
    "javascript": ("js", (
        "import x from './m{i}';\n"
        "class A{i} extends B {\n"
        "  run() { return help_{i}(1); }\n"
        "}\n"
        'const f{i} = (a) => { return /[`\'"]/.test(a); };\n'
        "app.post('/p/{i}', f{i});\n"
    ), [
        ("Class", "A{i}", "d.f{i}.A{i}", 2), ("Method", "run", "d.f{i}.A{i}.run", 3), ("Function", "f{i}", "d.f{i}.f{i}", 5),
        ("call", "help_{i}", "d.f{i}.A{i}.run", 3), ("call", "test", "d.f{i}.f{i}", 5), ("call", "post", "d.f{i}", 6), ("import", "./m{i}", "", 1),
        ("INHERITS", "B", "d.f{i}.A{i}", 2), ("POST", "/p/{i}", "f{i}", 6),
    ]),
    "jsx": ("jsx", (
        "import x from './m{i}';\n"
        "export function View{i}() {\n"
        "  return use_{i}(`n ${fmt(1)}`);\n"
        "}\n"
    ), [
        ("Function", "View{i}", "d.f{i}.View{i}", 2), ("call", "use_{i}", "d.f{i}.View{i}", 3), ("call", "fmt", "d.f{i}.View{i}", 3),
        ("import", "./m{i}", "", 1),
    ]),
    "typescript": ("ts", (
        "import { x } from './m{i}';\n"
        "interface I{i} { run(): void; }\n"
        "class A{i} extends B implements I{i} {\n"
        "  run(): void { this.go(); }\n"
        "}\n"
        "type T{i} = string;\n"
    ), [
        ("Interface", "I{i}", "d.f{i}.I{i}", 2), ("Method", "run", "d.f{i}.I{i}.run", 2), ("Class", "A{i}", "d.f{i}.A{i}", 3),
        ("Method", "run", "d.f{i}.A{i}.run", 4), ("Type", "T{i}", "d.f{i}.T{i}", 6), ("call", "go", "d.f{i}.A{i}.run", 4),
        ("import", "./m{i}", "", 1), ("INHERITS", "B", "d.f{i}.A{i}", 3), ("IMPLEMENTS", "I{i}", "d.f{i}.A{i}", 3),
    ]),
    "tsx": ("tsx", (
        "import { x } from './m{i}';\n"
        "export const View{i} = (p: P) => {\n"
        "  return draw_{i}(p);\n"
        "};\n"
    ), [
        ("Function", "View{i}", "d.f{i}.View{i}", 2), ("call", "draw_{i}", "d.f{i}.View{i}", 3), ("import", "./m{i}", "", 1),
    ]),
    "go": ("go", (
        "package main\n"
        "\n"
        'import "lib/m{i}"\n'
        "\n"
        "type S{i} struct { n int }\n"
        "\n"
        "func (s *S{i}) Run() int { return help_{i}(1) }\n"
        "\n"
        "func main() {\n"
        '\tr.GET("/p/{i}", handle_{i})\n'
        "}\n"
    ), [
        ("Struct", "S{i}", "d.f{i}.S{i}", 5), ("Method", "Run", "d.f{i}.S{i}.Run", 7), ("Function", "main", "d.f{i}.main", 9),
        ("call", "help_{i}", "d.f{i}.S{i}.Run", 7), ("call", "GET", "d.f{i}.main", 10), ("import", "lib/m{i}", "", 3),
        ("GET", "/p/{i}", "handle_{i}", 10),
    ]),
    "rust": ("rs", (
        "use lib::m{i};\n"
        "struct S{i};\n"
        "trait T{i} { fn run(&self); }\n"
        "impl T{i} for S{i} {\n"
        "    fn run(&self) { help_{i}(1); }\n"
        "}\n"
    ), [
        ("Struct", "S{i}", "d.f{i}.S{i}", 2), ("Trait", "T{i}", "d.f{i}.T{i}", 3), ("Method", "run", "d.f{i}.T{i}.run", 3),
        ("Method", "run", "d.f{i}.run", 5), ("call", "help_{i}", "d.f{i}.run", 5), ("import", "lib::m{i}", "", 1),
        ("IMPLEMENTS", "T{i}", "d.f{i}.S{i}", 4),
    ]),
    "c": ("c", (
        '#include "m{i}.h"\n'
        "struct S{i} { int a; };\n"
        "#ifdef WIDE\n"
        "int run_{i}(long a) {\n"
        "#else\n"
        "int run_{i}(int a) {\n"
        "#endif\n"
        "  return help_{i}(a);\n"
        "}\n"
    ), [
        ("Struct", "S{i}", "d.f{i}.S{i}", 2), ("Function", "run_{i}", "d.f{i}.run_{i}", 4), ("call", "help_{i}", "d.f{i}.run_{i}", 8),
        ("import", "m{i}.h", "", 1),
    ]),
    "cpp": ("cpp", (
        "#include <m{i}>\n"
        "namespace n{i} {\n"
        "class A {\n"
        "  void run() { help_{i}(1); }\n"
        "};\n"
        "}\n"
    ), [
        ("Module", "n{i}", "d.f{i}.n{i}", 2), ("Class", "A", "d.f{i}.n{i}.A", 3), ("Method", "run", "d.f{i}.n{i}.A.run", 4),
        ("call", "help_{i}", "d.f{i}.n{i}.A.run", 4), ("import", "m{i}", "", 1),
    ]),
    "java": ("java", (
        "import lib.m{i}; import lib.Two;\n"
        "class A{i} extends B implements C {\n"
        "  void run() { help_{i}(1); }\n"
        "}\n"
    ), [
        ("Class", "A{i}", "d.f{i}.A{i}", 2), ("Method", "run", "d.f{i}.A{i}.run", 3), ("call", "help_{i}", "d.f{i}.A{i}.run", 3),
        ("import", "lib.m{i}", "", 1), ("import", "lib.Two", "", 1), ("INHERITS", "B", "d.f{i}.A{i}", 2), ("IMPLEMENTS", "C", "d.f{i}.A{i}", 2),
    ]),
    "csharp": ("cs", (
        "using Lib.M{i};\n"
        "namespace N{i} {\n"
        "  class A : B {\n"
        "    public int Total => Sum_{i}(1);\n"
        '    [HttpGet("/p/{i}")]\n'
        "    int Run() { return 1; }\n"
        "  }\n"
        "}\n"
    ), [
        ("Module", "N{i}", "d.f{i}.N{i}", 2), ("Class", "A", "d.f{i}.N{i}.A", 3), ("Field", "Total", "d.f{i}.N{i}.A.Total", 4),
        ("Method", "Run", "d.f{i}.N{i}.A.Run", 6), ("call", "Sum_{i}", "d.f{i}.N{i}.A", 4), ("import", "Lib.M{i}", "", 1),
        ("INHERITS", "B", "d.f{i}.N{i}.A", 3), ("GET", "/p/{i}", "Run", 5),
    ]),
    "kotlin": ("kt", (
        "import lib.m{i}\n"
        "class A{i} : B(), C {\n"
        "  fun run() { help_{i}(1) }\n"
        "}\n"
    ), [
        ("Class", "A{i}", "d.f{i}.A{i}", 2), ("Method", "run", "d.f{i}.A{i}.run", 3), ("call", "help_{i}", "d.f{i}.A{i}.run", 3),
        ("import", "lib.m{i}", "", 1), ("INHERITS", "B", "d.f{i}.A{i}", 2), ("IMPLEMENTS", "C", "d.f{i}.A{i}", 2),
    ]),
    "perl": ("pl", (
        "use Lib::M{i};\n"
        "sub run_{i} {\n"
        "  help_{i}(1);\n"
        "}\n"
    ), [
        ("Function", "run_{i}", "d.f{i}.run_{i}", 2), ("call", "help_{i}", "d.f{i}.run_{i}", 3), ("import", "Lib::M{i}", "", 1),
    ]),
    "dart": ("dart", (
        "import 'm{i}.dart';\n"
        "typedef H{i} = void Function(String);\n"
        "enum E { red, green }\n"
        "class A{i} extends B {\n"
        "  final String id;\n"
        "  String get name => help_{i}(id);\n"
        "}\n"
    ), [
        ("Type", "H{i}", "d.f{i}.H{i}", 2), ("Enum", "E", "d.f{i}.E", 3), ("Field", "red", "d.f{i}.E.red", 3),
        ("Field", "green", "d.f{i}.E.green", 3), ("Class", "A{i}", "d.f{i}.A{i}", 4), ("Field", "id", "d.f{i}.A{i}.id", 5),
        ("Method", "name", "d.f{i}.A{i}.name", 6), ("call", "help_{i}", "d.f{i}.A{i}.name", 6), ("import", "m{i}.dart", "", 1),
        ("INHERITS", "B", "d.f{i}.A{i}", 4),
    ]),
    "bash": ("sh", (
        "source ./m{i}.sh\n"
        "run_{i}() {\n"
        "  help_{i} x\n"
        "}\n"
        "run_{i}\n"
    ), [
        ("Function", "run_{i}", "d.f{i}.run_{i}", 2), ("call", "help_{i}", "d.f{i}.run_{i}", 3), ("call", "run_{i}", "d.f{i}", 5),
        ("import", "d/m{i}.sh", "", 1),
    ]),
    "toml": ("toml", (
        "[part{i}]\n"
        "key = 1\n"
        "[part{i}.sub]\n"
    ), [
        ("Field", "key", "d.f{i}.part{i}.key", 2), ("Module", "part{i}", "d.f{i}.part{i}", 1), ("Module", "part{i}.sub", "d.f{i}.part{i}.sub", 3),
    ]),
    "yaml": ("yaml", (
        "part{i}:\n"
        "  key: 1\n"
        "other: 2\n"
    ), [
        ("Module", "part{i}", "d.f{i}.part{i}", 1), ("Field", "key", "d.f{i}.part{i}.key", 2), ("Field", "other", "d.f{i}.other", 3),
    ]),
    "ini": ("ini", (
        "[part{i}]\n"
        "key = 1\n"
    ), [
        ("Field", "key", "d.f{i}.part{i}.key", 2), ("Module", "part{i}", "d.f{i}.part{i}", 1),
    ]),
    "make": ("mk", (
        "include m{i}.mk\n"
        "all: part{i}\n"
        "\tcc x\n"
        "part{i}:\n"
        "\tcc y\n"
    ), [
        ("Function", "all", "d.f{i}.all", 2), ("Function", "part{i}", "d.f{i}.part{i}", 4), ("call", "part{i}", "d.f{i}.all", 2),
        ("import", "d/m{i}.mk", "", 1),
    ]),
    "cmake": ("cmake", (
        "include(m{i}.cmake)\n"
        "function(run_{i} a)\n"
        "  help_{i}(x)\n"
        "endfunction()\n"
        "run_{i}(1)\n"
    ), [
        ("Function", "run_{i}", "d.f{i}.run_{i}", 2), ("call", "help_{i}", "d.f{i}.run_{i}", 3), ("call", "run_{i}", "d.f{i}", 5),
        ("import", "d/m{i}.cmake", "", 1),
    ]),
    "html": ("html", (
        '<link href="s{i}.css"><script src="j{i}.js"></script>\n'
        '<div id="part{i}"></div>\n'
    ), [
        ("Field", "part{i}", "d.f{i}.part{i}", 2), ("import", "s{i}.css", "", 1), ("import", "j{i}.js", "", 1),
    ]),
}


def _query(language: str):
    ending, text, _ = SOURCES[language]

    def run(spark, d):
        i = F.col("doc_id").cast("string")
        files = views.load(spark, d, "documents").select(F.concat(F.lit("d/f"), i, F.lit(f".{ending}")).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(text), F.lit("{i}"), i).alias("text"))
        e = extracted(files)
        parts = [
            facts(e, "definitions").select("file_path", F.col("label").alias("kind"), F.col("name").alias("x"), F.col("qualified_name").alias("y"), F.col("start_line").alias("line")),
            facts(e, "calls").select("file_path", F.lit("call").alias("kind"), F.col("callee_name").alias("x"), F.col("from_qualified_name").alias("y"), "line"),
            facts(e, "imports").select("file_path", F.lit("import").alias("kind"), F.col("target").alias("x"), F.lit("").alias("y"), "line"),
            facts(e, "relations").select("file_path", F.col("edge_type").alias("kind"), F.col("supertype_name").alias("x"), F.col("subtype_qualified_name").alias("y"), "line"),
            facts(e, "routes").select("file_path", F.col("method").alias("kind"), F.col("path").alias("x"), F.coalesce("handler_name", F.lit("")).alias("y"), "line"),
            facts(e, "errors").select("file_path", F.lit("error").alias("kind"), F.lit("").alias("x"), F.lit("").alias("y"), F.col("first_line").alias("line")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    run.__name__ = f"extract_{language}"
    return run


def _sql(language: str) -> str:
    ending, _, found = SOURCES[language]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(x)}, {quoted(y)}, {line})" for k, x, y, line in found)
    at = lambda c: f"replace({c}, '{{i}}', CAST(doc_id AS VARCHAR))"
    return f"SELECT 'd/f' || doc_id || '.{ending}' AS file_path, kind, {at('x')} AS x, {at('y')} AS y, CAST(line AS INTEGER) AS line FROM documents, (VALUES {values}) AS v(kind, x, y, line)"


QUERIES = {f"extract_{language}": _query(language) for language in SOURCES}
SQL = {f"extract_{language}": _sql(language) for language in SOURCES}
