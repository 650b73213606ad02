"""Registered trace queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each group; the driver compares all of them.
NAMES = "s2_profiles_from_batches m11b_context_policy m13d_own_deciles m13e_own_and_frozen_auc h3_domain_flags h12c_mixture_law d13_without_top_decile d14_flagged_medians b12_class_sample g17_population_holdout e5_decile_edges d1_profile d9_era_features d12_period_medians b11_reservoir b17_allow_list c8_set_overlap c10_volume_match c11_decile_match c12_length_pairs e4_action_gap_tokens e8_symbol_string e9b_cumulative_sum g1_auc g2_bootstrap_auc g6_recall_at_fpr g8_mann_whitney g9_ks_uniform g13_synchrony g15_holdout h2_domain h6_bigrams m7_symbol_tfidf m11_token_policy p3_rescaled_times p6_excess_matrix n1_components a1_sequence_csv a4_archive_scan a7_timelines s1_stream_ingest a8_account_folders g4_bootstrap_median g16_folds f3_component_ranks h3b_domain_classes h12b_log_normal_density p5b_log_normal_by_bin p7b_llr_auc p8b_zero_shot_medians g22b_excess_similarity x2b_era_hour_cosine d18b_class_terms f2b_top_terms d20b_post_block m13b_policy_folds g20b_frozen_specific_pairwise g14b_synchrony_of_matched_sets p9_variants a2b_parsed_times x3b_cells_that_agree m17b_refit_action_policy".split()


def canon(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal") else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canon(got) == canon(expected)


def test_every_query_is_callable():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(QUERIES) > 120
