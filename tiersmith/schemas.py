"""Declared schemas of the tables that jobs exchange."""

PARAMS = "task string, variance double, lengthscale double, rho double"
SEARCH_LOG = ("task string, variance double, variance_mle double, lengthscale double, rho double, seed bigint, "
              "objective_mle double, objective_mae double")
RUNS = ("levels int, lowest string, high_level bigint, low_level bigint, method string, datasets string, "
        "task_fractions double, train_time double, test_time double, "
        + ", ".join(f"{s}_{m} double" for m in ("error", "relative", "std")
                    for s in ("mae", "median_ae", "minimum_ae", "maximum_ae"))
        + ", " + ", ".join(f"{s}_{m} double" for m in ("error", "std") for s in ("pearson", "spearman", "kendall"))
        + ", target int, seed int")
CALIBRATION = "index bigint, tasks int, mu double, sigma double, truth_primary double, truth_secondary double"
STRUCTURES = ("file string, offset bigint, info map<string,string>, "
              "atoms array<struct<symbol:string,x:double,y:double,z:double>>")
