"""Schemas of the logical tables.  Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "floats": T.ArrayType(T.FloatType()), "ints": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in text.split())])


BASE_VECTORS = _schema("vec_id:long embedding:floats")
QUERY_VECTORS = _schema("query_id:long embedding:floats")
ID_LISTS = _schema("query_id:long ids:ints")
UNIFORM_ATTRIBUTE = _schema("vec_id:long attr:int")
RANK_ATTRIBUTE = _schema("attr_name:string vec_id:long rank:long cluster:int")
CLUSTER_ORDER = _schema("attr_name:string cluster:int pos:int")
CONDITIONS = _schema("condition:string correlation:string s_requested:double threshold:long s_achieved:double condition_id:string mask_hash:string")
GROUND_TRUTH = _schema("condition_id:string mask_hash:string query_hash:string query_id:long rank:int neighbor_id:long distance:double")
NEIGHBOURS = _schema("query_id:long rank:int neighbor_id:long distance:double")
RAW_RESULTS = _schema("method:string condition:string budget:int query_id:long rank:int neighbor_id:long distance:double")
PER_QUERY = _schema(
    "query_id:long condition:string condition_id:string correlation:string s_requested:double s_achieved:double method:string budget:int effective_list:long recall:double"
    " dist_exact:long dist_native:long filter_checks:long rounds:int last_fetch:long latency_us:double n_valid:int filter_violations:int distance_mismatches:int gt_tie_at_k:int n_scanned:long seed0:long"
)
EDGES = _schema("src:long pos:int dst:long")
REACH = _schema("method:string condition:string query_id:long seed0:long seed_passes:int n_targets:int graph:int sem:int cap:int")
DECOMPOSITION = _schema("method:string condition:string level:string realization:int s:double budget:int query_id:long L:double U:double N:double U_graph:double U_cap:double D:long F:long tie:int")
LOCAL_DENSITY = _schema("condition:string query_id:long k_local:int local_density:double")
QUERY_FEATURES = _schema("query_id:long probe_dc:long centroid_dc:long centroid_dist:double score_concentration:double lid:double")
PROXY = _schema("condition:string query_id:long rho_hat:double")
ORACLE = _schema("query_id:long method:string condition:string correlation:string s_achieved:double oracle_budget:double oracle_dist:double censored:boolean")
EFS_SWEEP = _schema("method:string efs:int mean_recall:double mean_ndis:double total_ndis:long filter_violations:long distance_mismatches:long max_abs_dist_err:double mean_latency_us:double ids_hash:string")
TIMING_TRIALS = _schema("method:string efs:int threads:int trial:int seconds:double qps:double batch_recall:double")
COMPONENTS = _schema("condition:string semantics:string nodes:long edges:long sccs:long largest_scc:long wccs:long largest_wcc:long")
