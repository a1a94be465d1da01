"""Schemas, fixed names and errors of the versioned store."""

from __future__ import annotations

from pyspark.sql import types as T

ZERO_HASH = "0" * 64
DEFAULT_BRANCH = "main"

KV = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
OVERLAY = T.StructType([*KV.fields[:1], T.StructField("value", T.BinaryType(), True)])
LEAF_PAIRS = T.StructType([T.StructField("leaf_hash", T.StringType()), *KV.fields, T.StructField("fan", T.StringType())])
MANIFEST = T.StructType(
    [T.StructField(n, t) for n, t in (("root_hash", T.StringType()), ("leaf_hash", T.StringType()), ("first_key", T.BinaryType()), ("last_key", T.BinaryType()), ("n_pairs", T.LongType()), ("n_bytes", T.LongType()))]
)
NODES = T.StructType([T.StructField(n, t) for n, t in (("node_hash", T.StringType()), ("kind", T.IntegerType()), ("level", T.IntegerType()), ("n_children", T.IntegerType()), ("body", T.BinaryType()))])
COMMITS = T.StructType([T.StructField(n, t) for n, t in (("commit_hash", T.StringType()), ("root_hash", T.StringType()), ("message", T.StringType()), ("parent", T.StringType()), ("ts", T.LongType()), ("depth", T.IntegerType()))])


class StoreError(Exception):
    """The base of this library's errors."""


class KeyNotFound(StoreError):
    pass


class InvalidKey(StoreError):
    pass


class CommitNotFound(StoreError):
    pass


class HashNotFound(StoreError):
    pass


class CorruptedData(StoreError):
    pass


class BranchExists(StoreError):
    pass


class BranchNotFound(StoreError):
    pass


class BranchPathConflict(StoreError):
    pass


class InvalidBranchName(StoreError):
    pass


class BranchNameEmpty(InvalidBranchName):
    pass


class BranchNameReserved(InvalidBranchName):
    pass


class CannotDeleteCurrentBranch(StoreError):
    pass


class InvalidHeadFormat(StoreError):
    pass


class DetachedHead(StoreError):
    pass


class ConcurrentUpdate(StoreError):
    """A ref moved since this store read it."""


class MergeConflict(StoreError):
    pass
