"""Write the physical plans of key queries to PLANS.md (evidence for the
scale review: pushed filters, partial aggregation, broadcast joins,
exchanges).  usage: python tools/show_plans.py [sf_dir]"""
import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oriel.plans.catalog import QUERIES  # noqa: E402
from oriel.session import local_session  # noqa: E402

KEY = ["q28_lexicon_sentiment", "q13_dict_lemma_pipeline", "q14_top_bigrams_by_class", "q21_kde",
       "q40_stratified_split", "q47_tfidf", "q36_recommend"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    out = ["# Physical plans of key queries", "",
           f"Generated by `tools/show_plans.py` on `{sf}` (local[*], AQE on; initial plans before AQE re-planning).", ""]
    for name in KEY:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[name](spark, sf).explain()
        out += [f"## {name}", "", "```", buf.getvalue().strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print("wrote", path)


if __name__ == "__main__":
    main()
