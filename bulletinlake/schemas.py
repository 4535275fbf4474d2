"""Table schemas, and readers' tolerance for missing columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "floats": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


ANNOUNCEMENTS = _schema(
    "id:long source:string source_id:string title:string summary:string url:string author:string category:string target:string period_start:string period_end:string "
    "relevance_score:double relevance_reason:string matched_keywords:string is_notified:int raw_data:string created_at:string updated_at:string business_domain:string "
    "domain_confidence:double obsidian_path:string embedding_id:long duplicate_of:long legacy:int council_score:double council_tags:string council_match:int council_only:int "
    "council_rechecked_at:string council_content_hash:string kind:string"
)
KEYWORDS = _schema("id:long keyword:string category:string weight:double is_active:int")
RUN_HISTORY = _schema("id:long started_at:string finished_at:string source:string total_fetched:int new_count:int relevant_count:int notified_count:int status:string error_message:string")
EMBEDDINGS = _schema("id:long announcement_id:long model_name:string embedding:floats dimensions:int created_at:string")
APPLICATIONS = _schema("id:long announcement_id:long status:string applied_date:string result_date:string result:string prepared_docs:string notes:string assigned_domain:string priority:int created_at:string updated_at:string")
RESEARCH_DOCUMENTS = _schema("id:long title:string doc_type:string period_start:string period_end:string content:string metadata:string obsidian_path:string version:int created_at:string updated_at:string")
COUNCIL_DROPPED = _schema("id:long source:string source_id:string title:string url:string posted_at:string company_score:double council_score:double reason:string seen_at:string")

#: Values that a reader gives columns an older table lacks; null in council_* means unmeasured.
DEFAULTS: Mapping[str, Any] = {"is_notified": 0, "legacy": 0, "council_only": 0, "kind": "gonggo", "business_domain": "", "domain_confidence": 0.0, "relevance_score": 0.0, "raw_data": "{}"}


def with_defaults(df: DataFrame, schema: T.StructType, defaults: Mapping[str, Any] = DEFAULTS) -> DataFrame:
    """``df`` in the schema's columns and types; missing columns get their default or null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])
