"""Column expressions: all of them stay inside the JVM."""

from chunkloom.functions.content import (  # noqa: F401
    NONBLANK,
    branch_of,
    citation,
    content_hash,
    cosine,
    decode_lenient,
    import_tokens,
    label_names,
    looks_binary,
    parse_ts,
    signature_valid,
    tokenize,
)
from chunkloom.functions.paths import (  # noqa: F401
    detect_language,
    full_name,
    is_safe_relative_path,
    module_stem,
    path_stem,
    repository_name,
)
