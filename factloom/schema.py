"""Fixed schemas of the tables that the stages exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = "struct<doc_id:string,start:int,end:int,quote:string>"
OBJECT = "struct<kind:string,s:string,i:bigint,d:double,b:boolean>"

DOCUMENTS = ("doc_id string, text string, uri string, title string, modality string, tier string, "
             "retrieved_at timestamp, metadata string, ord bigint")
CHUNKS = "doc_id string, idx int, start int, end int, text string"
FACTS = (
    "fact_id string, ord bigint, s_key string, s_type string, s_label string, predicate string, o_kind string, o_key string, "
    "o_type string, o_label string, o_repr string, polarity string, identity_keys array<string>, qualifiers map<string,string>, "
    "valid_from timestamp, valid_to timestamp, extractor string, confidence double, verdict string, support bigint, retired_at timestamp")
EVIDENCE = ("fact_id string, e_ord bigint, doc_id string, uri string, start int, end int, quote string, origin string, "
            "tier string, retrieved_at timestamp")
ENTITIES = "key string, type string, label string, aliases array<string>, external_id string, attributes map<string,string>"
LINKS = "source_key string, target_key string, kind string, score double, reason string, created_at timestamp"
TRIPLES = (
    "schema_version string, doc string, subject string, predicate string, object string, subject_type string, object_type string, "
    "start int, end int, quote string, polarity string, qualifiers map<string,string>, confidence double, extractor string, id string")

# Weights of the source tiers, and verdicts.
TIERS = {"curated": 1.0, "authoritative": 0.8, "community": 0.5, "unverified": 0.2}
VERDICTS = ("supported", "contradicted", "not_found", "unchecked")  # the more informative first


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
