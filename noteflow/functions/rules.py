"""Path, file and hash rules as column expressions (``Column`` in, ``Column`` out).

A rule that can fail gives a struct ``(value, error)``: the error names the
first check that failed and is null for a good row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, extensions and limits of the note store.
MAX_SEGMENT_BYTES = 255
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))]
#: Folders that hold no notes. Add the settings folder of the editor in use; rules read the list when they are called.
IGNORED_SEGMENTS = [".editor", ".sync-agent", ".trash"]
SYSTEM_FILES = [".DS_Store", "Thumbs.db"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp"]
ALLOWED_EXTENSIONS = [".md", *IMAGE_EXTENSIONS, ".pdf"]
EXCLUDED_EXTENSIONS = [".env", ".key", ".pem", ".p12", ".zip", ".7z", ".mp4", ".mov", ".exe", ".dll", ".db", ".sqlite"]
MIME_TYPES = {
    ".md": "text/markdown", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".gif": "image/gif", ".webp": "image/webp", ".pdf": "application/pdf",
}
MIB = 1024 * 1024
MAX_BYTES = {"markdown": 2 * MIB, "image": 10 * MIB, "pdf": 30 * MIB}
REVISION_MARKDOWN_BYTES = 10 * MIB


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def checked_path(raw: Column) -> Column:
    """struct(path, error). Segment checks look at the unstripped path."""
    path, parts = strip(raw), segments(raw)
    stem = lambda s: F.upper(F.substring_index(s, ".", 1))
    checks = [
        (path == "", "source path is required"),
        (F.contains(path, F.lit("\0")), "source path cannot contain NUL bytes"),
        (F.contains(path, F.lit("\\")), "source path must use forward slashes"),
        (F.startswith(path, F.lit("/")), "source path must be relative"),
        (F.exists(parts, lambda s: s.isin(".", "..") | (strip(s) == "")), "source path cannot contain empty or traversal parts"),
        (F.exists(parts, lambda s: s.rlike("[. ]$")), "source path segments cannot end with a dot or space"),
        (F.exists(parts, lambda s: F.octet_length(s) > MAX_SEGMENT_BYTES), "source path segments cannot exceed 255 bytes"),
        (F.exists(parts, lambda s: stem(s).isin(RESERVED_STEMS)), "source path cannot contain a reserved Windows filename"),
        (F.contains(segments(path)[0], F.lit(":")), "source path cannot include a drive prefix"),
    ]
    error = F.when(raw.isNull(), "source path is required")
    for failed, message in checks:
        error = error.when(failed, message)
    error = error.otherwise(F.lit(None))
    return F.struct(F.when(error.isNull(), path).alias("path"), error.alias("error"))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, IGNORED_SEGMENTS)))


def is_conflict_file(path: Column) -> Column:
    extensions = "|".join(e[1:] for e in ALLOWED_EXTENSIONS)
    return base_name(path).rlike(rf"(?s)^.*(\.conflict\..*|\.sync-conflict.*)\.({extensions})$")


def is_vectorizable(path: Column) -> Column:
    return F.endswith(path, F.lit(".md")) & ~is_conflict_file(path) & ~is_ignored(path)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a bare dot-name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def is_hidden(path: Column) -> Column:
    return F.exists(segments(path), lambda s: F.startswith(s, F.lit(".")))


def should_sync(path: Column, sync_attachments: bool = False) -> Column:
    """Markdown always; attachments where they are enabled; never hidden, system, ignored or conflict files."""
    kept = ~is_hidden(path) & ~base_name(path).isin(SYSTEM_FILES) & ~is_ignored(path) & ~is_conflict_file(path)
    wanted = F.endswith(path, F.lit(".md"))
    if sync_attachments:
        wanted = wanted | extension(path).isin(IMAGE_EXTENSIONS + [".pdf"])
    return kept & wanted


def is_relevant_event(path: Column, is_directory: Column, sync_attachments: bool = False) -> Column:
    return F.when(is_directory, ~is_hidden(path) & ~is_ignored(path)).otherwise(should_sync(path, sync_attachments))


def file_policy(path: Column) -> Column:
    """struct(extension, kind, max_bytes, vectorize, mime, error) of a good path."""
    ext = extension(path)
    error = F.when(ext.isin(EXCLUDED_EXTENSIONS), "file extension is explicitly excluded").when(~ext.isin(ALLOWED_EXTENSIONS), "file extension is not allowed")
    kind = F.when(ext == ".md", "markdown").when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext == ".pdf", "pdf")
    limit = F.when(kind == "markdown", MAX_BYTES["markdown"]).when(kind == "image", MAX_BYTES["image"]).when(kind == "pdf", MAX_BYTES["pdf"])
    mimes = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.struct(
        ext.alias("extension"), kind.alias("kind"), limit.cast("long").alias("max_bytes"), (kind == "markdown").alias("vectorize"),
        F.when(kind.isNotNull(), F.coalesce(F.try_element_at(mimes, ext), F.lit("application/octet-stream"))).alias("mime"), error.alias("error"),
    )


def size_error(path: Column, n_bytes: Column, markdown_bytes: int = MAX_BYTES["markdown"]) -> Column:
    policy = file_policy(path)
    limit = F.when(policy["kind"] == "markdown", F.lit(markdown_bytes)).otherwise(policy["max_bytes"])
    return (
        F.when(n_bytes < 0, "file size cannot be negative").when(policy["error"].isNotNull(), policy["error"]).when(n_bytes > limit, "file exceeds size limit")
    )


def checked_vault_id(raw: Column) -> Column:
    """The trimmed id, null where it breaks the rule."""
    return F.when(strip(raw).rlike("^[a-z0-9-]+$"), strip(raw))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def checked_hash(raw: Column, content: Column) -> Column:
    """struct(hash, error): a supplied hash, normalised and held against the content."""
    given = F.lower(strip(raw))
    error = F.when(~given.rlike("^[0-9a-f]{64}$"), "content hash must be 64 hex digits").when(given != sha256_text(content), "content hash does not match the content")
    return F.struct(F.when(error.isNull(), given).alias("hash"), error.alias("error"))


def base64_size(n: Column) -> Column:
    return F.ceil(n / 3).cast("long") * 4


def encoded_content(kind: Column, content: Column) -> Column:
    """Transport form: markdown as text, all else as base64."""
    return F.when(kind == "markdown", content.cast("string")).otherwise(F.base64(content))


def decoded_content(kind: Column, sent: Column) -> Column:
    """struct(content, error): strict decoding of the transport form."""
    raw = F.try_to_binary(sent, F.lit("base64"))
    bad = (kind != "markdown") & (raw.isNull() | (F.length(sent) % 4 != 0))
    content = F.when(kind == "markdown", F.encode(sent, "UTF-8")).otherwise(raw)
    return F.struct(F.when(~bad, content).alias("content"), F.when(bad, "content is not valid base64").alias("error"))
