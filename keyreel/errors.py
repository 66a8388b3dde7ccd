"""Error codes with process exit codes."""

from __future__ import annotations

import re

# Error codes and the exit code of each; codes not listed here exit with 1.
EXIT_CODES = {
    "USAGE": 2,
    "NOT_FOUND": 3,
    "FFMPEG_NOT_FOUND": 4,
    "VISION_NOT_READY": 5,
    "TEXT_VISION_BLOCKED": 5,
    "CANCELLED": 6,
    "GUARD": 7,
    "IO": 8,
}
CODES = (*EXIT_CODES, "PROBE_FAILED", "EXTRACT_FAILED", "ANALYZE_FAILED", "DETECT_FAILED", "SELECT_FAILED", "EXPORT_FAILED", "INTERNAL")


class FrameError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None, details: dict | None = None):
        super().__init__(f"{code}: {message}")
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        self.code, self.message, self.hint, self.details = code, message, hint, details

    @property
    def exit_code(self) -> int:
        return EXIT_CODES.get(self.code, 1)

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "hint": self.hint, "details": self.details, "exit_code": self.exit_code}


def as_frame_error(error: BaseException) -> FrameError:
    if isinstance(error, FrameError):
        return error
    if isinstance(error, KeyboardInterrupt):
        return FrameError("CANCELLED", "cancelled")
    # What fails on an executor, or in raise_error(), arrives as text that begins with its code.
    told = re.search(rf"\b({'|'.join(CODES)}): ([^\n]*)", str(error))
    return FrameError(told[1], told[2]) if told else FrameError("INTERNAL", str(error))
