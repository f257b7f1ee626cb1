"""Errors with the stable codes that clients match on."""

from __future__ import annotations


class EngineError(Exception):
    """Base class; ``code`` never changes for one kind of error."""

    code = "INTERNAL_ERROR"

    def __init__(self, message: str = "", code: str | None = None) -> None:
        super().__init__(message or (code or self.code))
        if code:
            self.code = code


def _kind(name: str, code: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": doc, "__module__": __name__})


# The codes of the public interface.
BadRequest = _kind("BadRequest", "BAD_REQUEST", "A parameter is out of place.")
InvalidJSON = _kind("InvalidJSON", "INVALID_JSON", "A command isn't JSON.")
InvalidContent = _kind("InvalidContent", "INVALID_CONTENT", "Content is blank.")
PayloadTooLarge = _kind("PayloadTooLarge", "PAYLOAD_TOO_LARGE", "Content is over the byte limit.")
MethodNotAllowed = _kind("MethodNotAllowed", "METHOD_NOT_ALLOWED", "The operation isn't offered here.")
NotFound = _kind("NotFound", "NOT_FOUND", "Nothing under that name.")
InternalError = _kind("InternalError", "INTERNAL_ERROR", "Anything else.")
Unauthorized = _kind("Unauthorized", "UNAUTHORIZED", "Kept for clients; the engine has no accounts.")
RateLimited = _kind("RateLimited", "RATE_LIMITED", "A window's request limit is used up.")
Conflict = _kind("Conflict", "CONFLICT", "The write clashes with what is there.")
MutationDisabled = _kind("MutationDisabled", "MUTATION_DISABLED", "Direct mutation by command is off.")
IndexIDRequired = _kind("IndexIDRequired", "INDEX_ID_REQUIRED", "No index was named.")
NeuronIDRequired = _kind("NeuronIDRequired", "NEURON_ID_REQUIRED", "No neuron was named.")
NeuronNotFound = _kind("NeuronNotFound", "NEURON_NOT_FOUND", "No neuron has that id.")
QueryRequired = _kind("QueryRequired", "QUERY_REQUIRED", "A search needs text.")
UUIDRequired = _kind("UUIDRequired", "UUID_REQUIRED", "A registry entry needs an id.")
UUIDNotRegistered = _kind("UUIDNotRegistered", "UUID_NOT_REGISTERED", "The index isn't registered.")
UUIDNotFound = _kind("UUIDNotFound", "UUID_NOT_FOUND", "No registry entry has that id.")
UUIDConflict = _kind("UUIDConflict", "UUID_CONFLICT", "The registry has that id already.")
