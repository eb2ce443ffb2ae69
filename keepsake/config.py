"""Fixed values and the settings that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the archive format's and the service's own.
PRIMARY_FORMAT = "xxh128"
MANIFEST_FORMATS = ("c4", "md5", "sha1", "xxh128", "xxh3", "xxh64")
READER_FORMATS = ("xxh128", "xxh64", "xxh3", "md5", "sha1")
ORIGIN_FORMATS = ("xxh64", "md5", "sha1")
HISTORY_DIR = "ascmhl"
SUPERSEDED_DIR = "ascmhl_superseded"
CHAIN_FILE = "ascmhl_chain.xml"
MANIFEST_NAMESPACE = "urn:ASC:MHL:v2.0"
CHAIN_NAMESPACE = "urn:ASC:MHL:DIRECTORY:v2.0"
DEFAULT_PATTERNS = (
    ".DS_Store",
    "._*",
    "Thumbs.db",
    "@eaDir",
    r"\#recycle",
    "ascmhl/",
    "ascmhl_superseded/",
)
IGNORE_PREFIXES = "_@#."
MTIME_TOLERANCE_NS = 1_000_000_000
LISTED_PATHS = 10
TOP_TYPES = 8
ROOT_FOLDER = "(project root)"
OVERDUE = "overdue"

STATES = (
    "unsealed",
    "queued",
    "hashing",
    "sealed",
    "changed",
    "needs_review",
    "ignored",
    "missing",
    "error",
)
HELD_STATES = ("ignored", "queued", "hashing")
TRANSIENT_STATES = ("queued", "hashing", "error")
WORK_KINDS = ("seal", "append", "accept_new_version", "verify", "root_manifest", "retire")
WORK_STATES = ("queued", "running", "done", "failed", "cancelled")
PRIORITY = {
    "accept_new_version": 30,
    "seal": 30,
    "append": 20,
    "verify": 10,
    "root_manifest": 5,
}
MANUAL_BONUS = 100
VERIFY_PROBLEMS = ("corrupt", "modified", "missing")
VERIFICATION_PREFIX = "verification:"
REVIEW_LOG_PREFIX = "needs review, nothing written: "


@dataclass(frozen=True)
class WorkingHours:
    """Weekdays are 0 (Monday) to 6; ``start > end`` crosses midnight."""

    days: tuple[int, ...] = (0, 1, 2, 3, 4)
    start: str = "09:00"
    end: str = "20:00"
    zone: str = "UTC"


@dataclass(frozen=True)
class ArchiveConfig:
    project_depth: int = 1
    ignore_prefixes: str = IGNORE_PREFIXES
    exclude_globs: tuple[str, ...] = ()
    settle_hours: int = 168
    verify_interval_days: int = 90
    tolerance_ns: int = MTIME_TOLERANCE_NS
    hours: WorkingHours = WorkingHours()

    def __post_init__(self) -> None:
        if self.project_depth < 0:
            raise ValueError("project_depth must be >= 0")
        if self.verify_interval_days < 1:
            raise ValueError("verify_interval_days must be >= 1")
