"""Fixed schemas of the logical tables (no inference anywhere)."""

from pyspark.sql import types as T

SOURCE_FILES = "repo string, path string, size_bytes bigint, content string"
ENTITIES = (
    "repo string, path string, name string, type string, start_line int, end_line int, signature string, "
    "docstring string, parent string, decorators array<string>, parameters array<string>, return_type string, "
    "visibility string"
)
IMPORTS = (
    "repo string, path string, module string, imported_names array<string>, alias string, is_relative boolean, "
    "line_number int"
)
CHUNKS = (
    "repo string, chunk_id string, file_path string, entity_name string, entity_type string, language string, "
    "start_line int, end_line int, signature string, docstring string, parent string, parameters array<string>, "
    "return_type string, decorators array<string>, visibility string, code_content string, context_header string, "
    "tokens_estimate int"
)
VECTORS = (
    "collection string, chunk_id string, embedding array<float>, model string, dimension int, entity_type string, "
    "version bigint"
)
HITS = "query_id bigint, rank int, chunk_id string, score double, search_mode string, reasons array<string>"
TRACES = "trace_id bigint, repo string, text string, language_hint string, user_file_path string"
TEST_RUNS = "run_id bigint, stdout string, stderr string, exit_code int, timed_out boolean, error string"

COVERAGE_JSON = T.StructType(
    [
        T.StructField(
            "files",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "summary",
                            T.StructType(
                                [
                                    T.StructField("num_statements", T.LongType()),
                                    T.StructField("covered_lines", T.LongType()),
                                    T.StructField("missing_lines", T.LongType()),
                                    T.StructField("percent_covered", T.DoubleType()),
                                ]
                            ),
                        ),
                        T.StructField("missing_lines", T.ArrayType(T.StringType())),
                    ]
                ),
            ),
        ),
        T.StructField(
            "totals",
            T.StructType(
                [
                    T.StructField("num_statements", T.LongType()),
                    T.StructField("covered_lines", T.LongType()),
                    T.StructField("missing_lines", T.LongType()),
                ]
            ),
        ),
    ]
)

REVIEW_JSON = (
    "executive_summary string, findings array<struct<title:string,problem:string,category:string,severity:string,"
    "confidence:string,start_line:string,end_line:string,evidence:string,recommendation:string,"
    "suggested_change:string>>"
)
