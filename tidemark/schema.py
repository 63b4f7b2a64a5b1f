"""Row layout of a changelog and the errors its operations raise."""

from __future__ import annotations

from pyspark.sql import types as T

INSERT, DELETE, COMMAND = 0, 1, 2

#: One relation holds everything: a store is a set of such rows.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("kvs", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("meta", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

MAX_SEQ = 2**63 - 1  # sequence numbers are signed longs here; larger ones are refused

STATUS = {
    "OK": 0,
    "INVALID_PARAMETERS": -1,
    "INVALID_SEQNUM": -7,
    "SEQNUM_NOT_FOUND": -8,
    "INVALID_LEVEL": -9,
    "LOG_NOT_SYNCED": -14,
    "ALREADY_PURGED": -15,
    "KEY_NOT_FOUND": -16,
    "OUT_OF_RANGE": -19,
    "NOT_KV_PAIR": -23,
    "LOG_NOT_EXIST": -27,
    "OPERATION_IN_PROGRESS": -28,
    "WRITE_VIOLATION": -30,
    "TABLES_ARE_DISABLED": -31,
    "INVALID_CHECKPOINT": -32,
    "ALREADY_FLUSHED": -35,
    "CHECKSUM_ERROR": -41,
    "FILE_CORRUPTION": -42,
    "INVALID_MODE": -44,
    "INVALID_HANDLE_USAGE": -45,
    "ROLLBACK_IN_PROGRESS": -56,
    "INCOMPLETE_LOG": -60,
    "EMPTY_BATCH": -62,
    "SEQINDEX_UNAVAILABLE": -67,
}
_NAMES = {v: k for k, v in STATUS.items()}


def status_name(code: int) -> str:
    """Name of a status code; every known code has one."""
    return _NAMES.get(code, "UNKNOWN_STATUS")


class StoreError(Exception):
    """Base of all errors; ``name`` and ``code`` identify the status."""

    name = "INVALID_PARAMETERS"

    def __init__(self, detail: str = ""):
        self.code = STATUS[self.name]
        super().__init__(f"{self.name} ({self.code}){': ' + detail if detail else ''}")


def _error(name: str) -> type[StoreError]:
    return type("".join(w.capitalize() for w in name.split("_")), (StoreError,), {"name": name})


InvalidParameters = _error("INVALID_PARAMETERS")
InvalidSeqnum = _error("INVALID_SEQNUM")
SeqnumNotFound = _error("SEQNUM_NOT_FOUND")
InvalidLevel = _error("INVALID_LEVEL")
LogNotSynced = _error("LOG_NOT_SYNCED")
AlreadyPurged = _error("ALREADY_PURGED")
KeyNotFound = _error("KEY_NOT_FOUND")
OutOfRange = _error("OUT_OF_RANGE")
NotKvPair = _error("NOT_KV_PAIR")
LogNotExist = _error("LOG_NOT_EXIST")
OperationInProgress = _error("OPERATION_IN_PROGRESS")
WriteViolation = _error("WRITE_VIOLATION")
TablesAreDisabled = _error("TABLES_ARE_DISABLED")
InvalidCheckpoint = _error("INVALID_CHECKPOINT")
AlreadyFlushed = _error("ALREADY_FLUSHED")
ChecksumError = _error("CHECKSUM_ERROR")
FileCorruption = _error("FILE_CORRUPTION")
InvalidMode = _error("INVALID_MODE")
InvalidHandleUsage = _error("INVALID_HANDLE_USAGE")
RollbackInProgress = _error("ROLLBACK_IN_PROGRESS")
IncompleteLog = _error("INCOMPLETE_LOG")
EmptyBatch = _error("EMPTY_BATCH")
SeqindexUnavailable = _error("SEQINDEX_UNAVAILABLE")
