"""Schemas of the model tables. Columns are never inferred."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


L, S, B = T.LongType(), T.StringType(), T.BooleanType()
ENTRY = _schema(term=L, command=T.BinaryType(), no_op=B)
LOG = _schema(idx=L, term=L, key=L, value=S, no_op=B)
MATCH = _schema(peer=L, match_index=L)
NODE_STATE = _schema(node=L, role=S, current_term=L, voted_for=L, commit_index=L, last_applied=L)
APPLY = _schema(idx=L, term=L, command_valid=B, key=L, value=S)
KV = _schema(key=L, value=S, idx=L)
SUBMITS = _schema(client=L, op=L, term=L, idx=L)
RPC_TRACE = _schema(src=L, dst=L, send_seq=L, arrive_ord=L)
APPEND_ENTRIES = _schema(term=L, leader_id=L, prev_log_index=L, prev_log_term=L, entries=T.ArrayType(ENTRY), leader_commit=L)
REQUEST_VOTE = _schema(term=L, candidate_id=L, last_log_index=L, last_log_term=L)
MEASURE = _schema(scenario=S, trial=L, milliseconds=T.DoubleType())
DURABLE = _schema(current_term=L, voted_for=L, log=T.ArrayType(ENTRY))
