"""What can go wrong, on registration and in evaluation."""

from __future__ import annotations


class SchemaError(Exception):
    """Base of all errors of this engine; ``location`` is a schema location where there is one."""

    def __init__(self, message: str, location: str | None = None) -> None:
        super().__init__(message + (f" at {location}" if location else ""))
        self.location = location


class InvalidSchemaError(SchemaError): ...
class InvalidIdentifierError(SchemaError): ...
class InvalidRegexError(InvalidSchemaError): ...
class UnsafeRegexError(InvalidSchemaError): ...
class MetaschemaValidationError(InvalidSchemaError): ...
class DuplicateResourceError(SchemaError): ...
class DuplicateAnchorError(SchemaError): ...
class UnknownDialectError(SchemaError): ...
class UnknownVocabularyError(SchemaError): ...
class UnknownKeywordError(SchemaError): ...
class UnknownFormatError(SchemaError): ...
class UnresolvableReferenceError(SchemaError): ...
class ResourceNotFoundError(UnresolvableReferenceError): ...
class AnchorNotFoundError(UnresolvableReferenceError): ...
class PointerNotFoundError(UnresolvableReferenceError): ...
class InfiniteLoopError(SchemaError): ...
class MaxDepthExceededError(SchemaError): ...
class OutputOptionsError(SchemaError): ...
class LoaderError(SchemaError): ...
class UnregisterError(SchemaError): ...
class JsonSyntaxError(SchemaError): ...


class NeedsKernel(SchemaError):
    """A schema, or this part of it, has no Column form; the kernel evaluates it."""
