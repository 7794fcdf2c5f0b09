"""Schemas of the store's tables and of the records that jobs take and give."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    """A struct of 'name type' pairs; ! after a type: not null."""
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
        "boolean": T.BooleanType(), "floats": T.ArrayType(T.FloatType(), False), "strings": T.ArrayType(T.StringType(), False),
    }
    return T.StructType([T.StructField(n, kinds[t.rstrip("!")], not t.endswith("!")) for n, t in (x.split() for x in ddl.split(","))])


NOTES = _schema(
    "id long!,client_name string!,scope string!,path_or_uri string!,name string,description string,type string,provenance_kind string,"
    "provenance_date date,status string,content_hash string!,pipeline_version string!,body string!,meta string!,created_at timestamp!,updated_at timestamp!"
)
PASSAGES = _schema(
    "id long!,note_id long!,client_name string!,scope string!,ordinal int!,heading_path string,content string!,embedding floats,embedding_degenerate boolean!"
)
API_KEYS = _schema("id long!,key_prefix string,key_hash string!,client_name string!,created_at timestamp,revoked_at timestamp")
INGEST_REQUESTS = _schema(
    "request_id long,arrived_at timestamp,op string,client_name string,scope string,repo_name string,path_or_uri string,content string,status string,meta string,force boolean"
)
QUERIES = _schema("query_id long!,client_name string!,q string,top_k int,repo_filter string,query_vector floats")
GOLDEN = _schema("query string,expect_path_or_uri strings,notes string")
