"""Complete-link groups inside components of similar records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def complete_link(rows: DataFrame, threshold: float) -> DataFrame:
    """(component, id, grp, size, similarity): each record joins the first group of its component all of whose members reach the threshold.

    rows (component, id, vector); records go in id order, grp is the group's first id, similarity the cosine to it;
    groups of one are left out. The choice is sequential by definition, so a component is one task: callers bound
    the number of vectors they cluster, as a desktop catalogue does.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["vector"]).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        groups: list[list[int]] = []
        for i in range(len(ids)):
            home = next((g for g in groups if (x[g] @ x[i] >= threshold).all()), None)
            groups.append([i]) if home is None else home.append(i)
        out = [(pdf["component"].iloc[0], ids[i], ids[g[0]], len(g), round(float(x[i] @ x[g[0]]), 6)) for g in groups if len(g) > 1 for i in g]
        return pd.DataFrame(out, columns=["component", "id", "grp", "size", "similarity"])

    return rows.select("component", "id", "vector").groupBy("component").applyInPandas(split, "component BIGINT, id BIGINT, grp BIGINT, size INT, similarity DOUBLE")
