"""Payload codecs: JSON sizes, envelopes, overflow, file paths and previews."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits in bytes.
INLINE_RESULT = 262_144
RESPONSE = 6_291_406
OVERFLOW = 261_120
UPDATE_OVERHEAD = 256
PREVIEW = 4096
#: Key of an envelope's header.
HEADER = "__ledgerfold"


@dataclass(frozen=True)
class Codec:
    """How a value is written to the log and read back, as functions of a column. An input that is only sent has no reader."""

    write: Callable[[Column], Column]
    read: Callable[[Column], Column] | None = None


#: Strings as they are.
PASSTHROUGH = Codec(lambda value: value, lambda text: text)


def json_codec(schema: str) -> Codec:
    """JSON of values of one schema."""
    return Codec(F.to_json, lambda text: F.from_json(text, schema))


def json_escaped_length(text: Column) -> Column:
    """Bytes of a text inside a JSON string: escapes of two bytes, other control characters six."""
    short = F.regexp_count(text, F.lit('["\\\\\\x08\\t\\n\\f\\r]'))
    long = F.regexp_count(text, F.lit("[\\x00-\\x07\\x0B\\x0E-\\x1F]"))
    return F.coalesce(F.octet_length(text) + short + 5 * long, F.lit(0))


def update_size(*texts: Column) -> Column:
    """Estimated bytes of one update in a request."""
    size = F.lit(UPDATE_OVERHEAD)
    for t in texts:
        size = size + json_escaped_length(t)
    return size


def _header(kind: str) -> str:
    return f'{{"{HEADER}":{{"version":1,"kind":"{kind}"}},'


def inline_envelope(value_json: Column) -> Column:
    return F.concat(F.lit(_header("inline") + '"value":'), value_json, F.lit("}"))


def file_envelope(path: Column, preview_json: Column | None = None) -> Column:
    own = F.concat(F.lit(_header("file") + '"file":'), F.to_json(F.array(path)).substr(F.lit(2), F.length(F.to_json(F.array(path))) - 2))
    end = F.lit("}")
    if preview_json is None:
        return F.concat(own, end)
    return F.concat(own, F.coalesce(F.concat(F.lit(',"preview":'), preview_json), F.lit("")), end)


def stored_payload(value_json: Column, path: Column, preview_json: Column | None = None, always: bool = False) -> Column:
    """The inline envelope, or the file envelope where the inline one is too large (or always)."""
    inline = inline_envelope(value_json)
    file = file_envelope(path, preview_json)
    return file if always else F.when(F.octet_length(inline) > OVERFLOW, file).otherwise(inline)


def envelope_kind(payload: Column) -> Column:
    return F.get_json_object(payload, f"$.{HEADER}.kind")


def response_envelope(status: Column, result: Column, error_json: Column) -> Column:
    """What an invocation answers; a result over the limit is left empty (it stands in the log)."""
    shown = F.when(F.octet_length(result) > RESPONSE, "").otherwise(result)
    return F.to_json(F.struct(status.alias("Status"), F.when(status == "SUCCEEDED", shown).alias("Result"), F.when(status == "FAILED", error_json).alias("Error")))


def percent_encoded(text: Column) -> Column:
    """All bytes but letters, digits and -_.~ as %XX; a lone . or .. is neutralised."""
    chars = F.split(text, "")
    coded = F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c.rlike("^[A-Za-z0-9._~-]$") | (c == ""), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")),
        ),
        "",
    )
    return F.when(text.isin(".", ".."), F.concat(F.lit("%2E"), F.substring(text, 2, 1))).otherwise(coded)


def hashed_segment(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def path_is_contained(path: Column) -> Column:
    """Whether a relative path stays below its base."""
    return ~(path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.?(/|$)") | (path == "") | path.isNull())


def preview_of(fields: dict[str, Column], how: Preview) -> Column:
    """The preview of a payload whose paths are known, as JSON: fields by path, nested where paths have dots.

    For previews that stay below the limit whatever the values; others need preview_json.
    """
    shown: dict = {}
    for path, value in fields.items():
        if how.hides(path):
            continue
        *above, last = path.split(".")
        at = shown
        for key in above:
            at = at.setdefault(key, {})
        at[last] = F.lit(how.mask_text) if how.masks(path) else value

    def made(node: dict) -> Column:
        return F.struct(*((made(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()))

    return F.to_json(made(shown))


@dataclass(frozen=True)
class Preview:
    """Which fields a preview shows. A field without a dot means that name anywhere, with one exactly that path."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    mask: tuple[str, ...] = ()
    show_all: bool = False
    mask_text: str = "***"
    limit: int = PREVIEW
    unsafe: frozenset = field(default=frozenset({"__proto__", "constructor", "prototype"}))

    def _in(self, names: tuple[str, ...], path: str) -> bool:
        return any(path == n if "." in n else path.rpartition(".")[2] == n for n in names)

    def masks(self, path: str) -> bool:
        """Whether a path, or what it is part of, is shown as the mask."""
        parts = path.split(".")
        return any(self._in(self.mask, ".".join(parts[: i + 1])) for i in range(len(parts)))

    def hides(self, path: str) -> bool:
        parts = path.split(".")
        if any(p in self.unsafe for p in parts) or any(self._in(self.exclude, ".".join(parts[: i + 1])) for i in range(len(parts))):
            return True
        return not (self.masks(path) or self.show_all or self._in(self.include, path))

    def fields(self, node, prefix: str = ""):
        """(path, value) of what is shown, in document order."""
        if isinstance(node, list):
            for x in node:
                yield from self.fields(x, prefix)
        elif isinstance(node, dict):
            for key, value in node.items():
                if "." in key or key in self.unsafe:
                    continue
                path = f"{prefix}.{key}" if prefix else key
                if self._in(self.exclude, path):
                    continue
                if self._in(self.mask, path):
                    yield path, self.mask_text
                elif (self.show_all or self._in(self.include, path)) and not isinstance(value, dict | list):
                    yield path, value
                else:
                    yield from self.fields(value, path)

    def of(self, text: str | None) -> str | None:
        """The preview of a JSON text as JSON, cut at the limit; None if nothing is shown."""
        try:
            root = json.loads(text or "", parse_float=_Raw, parse_int=_Raw)
        except ValueError:
            return None
        out: dict = {}
        size = 2
        for path, value in self.fields(root):
            size += len(path.encode()) + len(_compact(value).encode()) + 4
            if size > self.limit:
                break
            *above, last = path.split(".")
            at = out
            for key in above:
                if not isinstance(at.get(key), dict):
                    at[key] = {}
                at = at[key]
            at[last] = value
        return _compact(out) if out else None


class _Raw(str):
    """A number as it stands in the text, so that no digit is lost."""


def _compact(value) -> str:
    if isinstance(value, _Raw):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def preview_json(how: Preview):
    """A pandas UDF from JSON text to its preview; for payloads without a fixed schema."""

    @F.pandas_udf("string")
    def previews(texts: pd.Series) -> pd.Series:
        return texts.map(how.of)

    return previews
