"""The catalog: compiled documents by URI, loaders, formats, decoders, default functions, options."""

from __future__ import annotations

import base64
import datetime
import uuid as _uuid
from collections.abc import Callable
from typing import Any
from urllib.parse import urldefrag, urljoin

from pactlake.functions import formats, numbers
from pactlake.plans import metaschemas
from pactlake.plans.schema import DIALECTS, LATEST, VALIDATION_VOCABULARIES, Builder, Loader, Schema, SchemaError, UnresolvedReference, check_patterns, pointer


class PatternError(SchemaError):
    """Regular expressions outside the dialect; ``places`` lists (location, pattern)."""

    def __init__(self, places: list[tuple[str, str]]):
        super().__init__(f"invalid patterns: {places}")
        self.places = places


def _base64(text: str) -> bytes:
    return base64.b64decode(text.encode("ascii"), validate=True)


def _xml(data: bytes) -> Any:
    import xml.etree.ElementTree as ElementTree

    ElementTree.fromstring(data)


def _yaml(data: bytes) -> Any:
    import yaml

    return yaml.safe_load(data)


class Catalog:
    """Compiles documents on the driver; pickled with a plan to the executors.

    on_unresolved: "error" raises when a reference without a target is evaluated, "ignore" lets it pass.
    """

    def __init__(self, *, default_dialect: str = LATEST, base_uri: str = "", assert_format: bool = False, preserve_extra: bool = False, on_unresolved: str = "error", decode: Callable[[str | bytes], Any] = numbers.parse, encode: Callable[[Any], str] = numbers.dumps):
        self.default_dialect, self.base_uri = default_dialect.rstrip("#"), base_uri
        self.assert_format, self.preserve_extra, self.on_unresolved = assert_format, preserve_extra, on_unresolved
        self.decode, self.encode = decode, encode  # of instances; a codec of one's own answers for exact numbers
        self.documents: dict[str, Schema] = {}
        self.nodes: dict[int, Schema] = {}
        self.loaders: dict[str, Loader] = {}
        self.custom_formats: dict[str, tuple[Callable[[Any], bool], str]] = {}
        self.decoders: dict[str, Callable[[str], bytes]] = {"base64": _base64}
        self.media_types: dict[str, Callable[[bytes], Any]] = {"application/json": numbers.parse, "application/xml": _xml, "application/yaml": _yaml}
        self.default_functions: dict[str, Callable[..., Any]] = {}
        self._unresolved: dict[str, set[str]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"nodes": list(self.nodes.values())}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state  # the nodes may not be complete yet

    def _settle(self) -> None:
        if isinstance(self.nodes, list):  # as unpickled
            self.nodes = {id(n.raw): n for n in self.nodes}

    # Registries

    def register_loader(self, scheme: str, load: Loader) -> None:
        self.loaders[scheme] = load

    def register_format(self, name: str, holds: Callable[[Any], bool], type_name: str = "") -> None:
        """A predicate, asked only for values of ``type_name`` if one is given; it replaces a built-in."""
        self.custom_formats[name] = (holds, type_name)

    def unregister_format(self, name: str) -> None:
        self.custom_formats.pop(name, None)

    def register_decoder(self, name: str, decode: Callable[[str], bytes]) -> None:
        self.decoders[name] = decode

    def register_media_type(self, name: str, parse: Callable[[bytes], Any]) -> None:
        self.media_types[name] = parse

    def register_default_function(self, name: str, make: Callable[..., Any]) -> None:
        self.default_functions[name] = make

    # Compilation

    def compile(self, document: str | bytes | dict | bool, uri: str | None = None) -> Schema:
        """Compiles a document; a URI that is known gives what was compiled for it first."""
        root = self._build(document, uri)
        if bad := check_patterns(root):
            self._forget(root)
            raise PatternError(bad)
        return root

    def compile_batch(self, documents: dict[str, str | bytes | dict | bool]) -> dict[str, Schema]:
        """Compiles documents that may refer to one another; patterns are not checked."""
        return {uri: self._build(d, uri) for uri, d in documents.items()}

    def _build(self, document: str | bytes | dict | bool, uri: str | None) -> Schema:
        raw = numbers.parse(document) if isinstance(document, (str, bytes)) else document
        if uri is not None and (known := self.documents.get(urldefrag(urljoin(self.base_uri, uri))[0])):
            return known
        builder = Builder(self)
        own = raw.get("$id", raw.get("id")) if isinstance(raw, dict) else None
        base = urljoin(self.base_uri, uri or "") or (self.base_uri if isinstance(own, str) else f"urn:anonymous:{_uuid.uuid4()}")
        root = builder.build(raw, urldefrag(base)[0], self.default_dialect)
        if root.base in self.documents and not root.base.startswith("urn:anonymous") and isinstance(own, str) and uri is None:
            return self.documents[root.base]
        for name, node in builder.resources.items():
            self.documents.setdefault(name, node)
        self.documents.setdefault(urldefrag(base)[0], root)
        self._settle()
        self.nodes.update(builder.nodes)
        self._track(root)
        return root

    def _forget(self, root: Schema) -> None:
        for name in [n for n, s in self.documents.items() if s is root]:
            del self.documents[name]

    def _track(self, root: Schema) -> None:
        """Notes which URIs other documents have to supply, and binds what has been waiting."""
        for waiting in list(self._unresolved):
            if waiting in self.documents:
                del self._unresolved[waiting]
        for node in root.walk():
            for k in ("$ref", "$dynamicRef"):
                if isinstance(node.get(k), str) and (name := urldefrag(urljoin(node.base, node.get(k)))[0]) not in self.documents:
                    self._unresolved.setdefault(name, set()).add(root.base)

    def unresolved_references(self) -> list[str]:
        """URIs of documents that have been referred to but not compiled."""
        return sorted(self._unresolved)

    def schema(self, uri: str) -> Schema:
        """A compiled document by its URI, loaded if a loader knows its scheme."""
        name, fragment = urldefrag(urljoin(self.base_uri, uri))
        node = self._document(name)
        return self._inside(node, fragment)

    def set_schema(self, uri: str, node: Schema) -> None:
        self.documents[uri] = node

    def _document(self, name: str) -> Schema:
        if name in self.documents:
            return self.documents[name]
        if name.rstrip("#") in DIALECTS:
            return self._build(metaschemas.metaschema(name.rstrip("#")), name)
        load = self.loaders.get(name.partition(":")[0])
        if load is None:
            raise UnresolvedReference(name)
        return self._build(load(name), name)

    def _inside(self, resource: Schema, fragment: str) -> Schema:
        from urllib.parse import unquote

        if not fragment:
            return resource
        if not fragment.startswith("/"):
            found = resource.anchors.get(unquote(fragment))
            if found is None:
                raise UnresolvedReference(fragment)
            return found[0]
        node = resource
        *_, raw = [last for last in self._along(resource, fragment)]
        if isinstance(raw, Schema):
            return raw
        return Builder(self).build(raw, node.base, node.dialect, fragment, node.resource)

    def _along(self, resource: Schema, fragment: str):
        self._settle()
        for raw in pointer(resource.raw, fragment):
            yield self.nodes.get(id(raw), raw) if isinstance(raw, dict) else raw

    def resolve(self, node: Schema, ref: str) -> Schema | None:
        """The target of a reference as seen from a node; None if it is not known and may be ignored."""
        try:
            name, fragment = urldefrag(urljoin(node.base, ref))
            if name == node.base or not name:
                return self._inside(node.resource, fragment)
            return self._inside(self._document(name), fragment)
        except UnresolvedReference:
            if self.on_unresolved == "ignore":
                return None
            raise UnresolvedReference(f"{ref} in {node.base}") from None

    # Dialects

    def dialect_of(self, uri: str) -> str:
        """The known dialect whose rules hold for ``$schema``: its own or, for a metaschema, that one's."""
        for _ in range(8):
            if uri in DIALECTS:
                return uri
            known = self.documents.get(uri)
            said = known.raw.get("$schema") if known is not None and isinstance(known.raw, dict) else None
            if not isinstance(said, str) or said.rstrip("#") == uri:
                break
            uri = said.rstrip("#")
        return self.default_dialect if self.default_dialect in DIALECTS else LATEST

    def validates(self, uri: str) -> bool:
        """Whether a metaschema that declares vocabularies lists the validation one."""
        known = self.documents.get(uri)
        if known is None and uri not in DIALECTS and uri.partition(":")[0] in self.loaders:
            try:
                known = self._document(uri)
            except (UnresolvedReference, SchemaError, OSError, KeyError):
                return True
        said = known.raw.get("$vocabulary") if known is not None and isinstance(known.raw, dict) else None
        return not isinstance(said, dict) or bool(VALIDATION_VOCABULARIES & said.keys())

    def validate_schema(self, document: str | bytes | dict | bool):
        """Evaluates a document against its dialect's metaschema."""
        from pactlake.operators.evaluate import evaluate

        raw = numbers.parse(document) if isinstance(document, (str, bytes)) else document
        said = raw.get("$schema") if isinstance(raw, dict) else None
        return evaluate(self._document((said or self.default_dialect).rstrip("#")), raw)

    def format_holds(self, name: str, value: Any, type_name: str) -> bool | None:
        """None for a format that nobody has registered."""
        if name in self.custom_formats:
            holds, scope = self.custom_formats[name]
            fits = not scope or scope == type_name or (scope == "number" and type_name == "integer")
            return not fits or bool(holds(value))
        holds = formats.FORMATS.get(name)
        return None if holds is None else not isinstance(value, str) or holds(value)


def now(layout: str = "2006-01-02T15:04:05Z07:00") -> str:
    """The present in UTC; the layout is an example of the reference instant."""
    at = datetime.datetime.now(datetime.UTC)
    for part, code in LAYOUT:
        layout = layout.replace(part, code)
    return at.strftime(layout)


#: Parts of a layout and their codes.
LAYOUT = (("2006", "%Y"), ("January", "%B"), ("Monday", "%A"), ("Z07:00", "Z"), ("01", "%m"), ("02", "%d"), ("15", "%H"), ("04", "%M"), ("05", "%S"), ("Jan", "%b"), ("Mon", "%a"))
