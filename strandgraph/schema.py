"""Data model: a labelled property multigraph, facts per file, coverage per file."""

from __future__ import annotations

# The closed vocabularies of the model.
NODE_LABELS = ("Project", "File", "Package", "Module", "Function", "Method", "Class", "Type", "Interface", "Trait", "Struct", "Enum", "Field", "Route", "Adr", "TraceSpan")
EDGE_TYPES = ("CONTAINS", "DEFINES", "CALLS", "CALL_UNRESOLVED", "IMPORTS", "INHERITS", "IMPLEMENTS", "HAS_FIELD", "ROUTES_TO", "CONFIG_REF", "PROTO_REF", "OPENAPI_REF", "IMPACTS")
EVIDENCE = ("ast", "lsp", "hybrid", "trace")
STATUSES = ("indexed", "parse_partial", "skipped", "excluded")
REASONS = ("gitignore", "binary", "oversized", "unsupported_language", "parse_error", "read_error", "symlink_escape")
LANGUAGES = ("python", "javascript", "jsx", "typescript", "tsx", "go", "rust", "c", "cpp", "java", "csharp", "kotlin", "perl", "bash", "toml", "yaml", "ini", "make", "cmake", "html", "dart")
SERVER_LANGUAGES = LANGUAGES[:13]
RESOLVED_TYPES = ("CALLS", "CALL_UNRESOLVED", "IMPORTS", "INHERITS", "IMPLEMENTS", "ROUTES_TO")

CALLABLES = ("Function", "Method")
UNRESOLVED = 0
SCHEMA_VERSION = 1
MAX_FILE_BYTES = 2 * 1024 * 1024
BINARY_WINDOW = 8000

# Reasons and evidence that edges carry in ``detail``.
RECEIVER_TYPE, SAME_FILE, SAME_MODULE, UNIQUE_NAME = "receiver_type_match", "same_file_name_match", "same_module_name_match", "unique_callable_name_in_project"
RECURSIVE, AMBIGUOUS = "recursive_self_call", "ambiguous_name_in_project"
NO_METHOD, SCOPE_MISMATCH, NO_DEFINITION = "receiver_type_unknown_no_matching_method", "name_known_but_scope_mismatch", "no_definition_in_index"
SELF_RECEIVERS = ("self", "this")

NODES = "id long, label string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, source string, confidence float, signature string, extra map<string,string>"
EDGES = "id long, src long, dst long, edge_type string, source string, confidence float, target_name string, detail string, line int"
FILES = "path string, hash string, size long, language string, status string, reason string, detail string, mtime_ns long"
DEFINITIONS = "file_path string, label string, name string, qualified_name string, start_line int, end_line int, signature string, returns string, language string"
CALLS = "from_qualified_name string, callee_name string, receiver string, line int, character int, file_path string"
IMPORTS = "from_file string, target string, line int"
TYPE_RELATIONS = "subtype_qualified_name string, supertype_name string, edge_type string, line int, file_path string"
ROUTES = "method string, path string, handler_name string, handler_receiver string, line int, end_line int, framework string, file_path string"
BINDINGS = "variable string, constructor string, file_path string"
JOURNAL = "at_unix long, tool string, argument_keys array<string>, project string, duration_ms long, ok boolean, error_code string, result_total long, has_more boolean"
ADRS = "id string, title string, status string, body string, related array<struct<qualified_name:string,file_path:string,start_line:int>>, updated_at_unix long"
PROJECTS = "id string, name string, root string, store_path string, indexed_at_unix long"


class GraphError(ValueError):
    """An error with a stable code, as the API reports it."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
