"""One error type with a kind, raised before any job runs wherever the fault can be seen in the request."""

from __future__ import annotations

CONFIGURATION = "Configuration"
CAPABILITY_UNAVAILABLE = "CapabilityUnavailable"
MALFORMED_INPUT = "MalformedInput"
PROCESSING = "Processing"
REDACTION = "Redaction"


class VeilError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message


def configuration(message: str) -> VeilError:
    return VeilError(CONFIGURATION, message)
