"""Time the headline queries and print one JSON line."""

import json
import os
import time

from kerbline.plans import catalogue
from kerbline.runtime import session

#: One query or more of each family; all registered ones with BENCH_ALL=1.
HEADLINE = """
    date01_survey_weeks agg01_weekly_counts agg02_bundle_totals agg05_leave_one_out agg06_dense_panel agg13_welch_balance agg24_two_way_effects agg27_weekly_summary agg33_cumulative_weeks
    jon01_eligible_without_history rnd01_seeded_draw win01_lagged_panel win02_extremes win04_empirical_cdf win06_ranked_fallback srt02_top_k set02_difference set03_keep_first
    dat08_any_date str01_addresses str04_stable_seeds geo01_haversine geo02_centroids flt01_patches flt05_zoning_include flt09_disjoint_bundles
    jon01_nearest_with_name jon03_point_in_polygon jon05_largest_overlap jon06_adjacent_segments jon13_eligible_by_previous_week jon14_cost_matrix jon16_previous_plan
    agg03_scenario_summary agg04_segment_analysis agg07_panel_closed_in_time agg08_used_bundles agg10_bundle_metadata agg11_size_measures agg17_balance_levels agg18_overlap agg20_eligibility_distribution
    agg21_unfixed agg22_fix_timing agg28_exposure smp01_first_day_draw smp02_d2ds_fallbacks smp05_thin_segments smp06_bundle_allocation grf01_connected_components grf02_connected_bundles grf14_odd_nodes
    grf17_greedy_workflow grf18_balanced_workflow grf21_walks asg01_optimal asg09_nearest_then_refine asg10_joint_tasks
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sorted(catalogue.queries()) if os.environ.get("BENCH_ALL") else HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
