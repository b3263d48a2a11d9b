"""python tests/llm/toxicity_folds.py SF_DIR: forms of the toxicity score, compared on five folds of the training split alone.

Held-out rows (crc32 of the id mod 5 = 0) are never read for their labels. Up to 8000 ordinary documents take part.
"""

import sys
import zlib

import duckdb
import numpy as np

from harvestry.llm import toxicity
from harvestry.llm.textnum import words

#: Which of Model.inputs() a form uses.
FORMS = {"mean": [0, 1], "common": [0], "beyond mean": [1], "beyond sum": [2], "sum, words": [2, 3], "means, words": [0, 1, 3], "common, sum": [0, 2], "all": [0, 1, 2, 3]}


def part(doc_id: int, what: str, n: int) -> int:
    return zlib.crc32(f"{what}{doc_id}".encode()) % n


def auc(y: np.ndarray, s: np.ndarray) -> float:
    rank, n = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0, y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def loss(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(np.clip(np.where(y == 1, -z, z), -30, 30)))


def main(sf_dir: str) -> None:
    sql = f"""select doc_id, coalesce(text, ''), toxic from '{sf_dir}/documents.parquet' join
      (select doc_id, max(toxic) as toxic from '{sf_dir}/labels.parquet' where toxic in (0, 1) group by 1) using (doc_id) where doc_id is not null order by 1"""
    rows = [r for r in duckdb.sql(sql).fetchall() if part(r[0], "", 5)]
    plain = [r for r in rows if r[2] == 0]
    rows = [r for r in rows if r[2] == 1] + [plain[i] for i in np.random.default_rng(1).permutation(len(plain))[:8000]]
    y, texts, fold = np.array([r[2] for r in rows]), [r[1] for r in rows], np.array([part(r[0], "f", 5) for r in rows])
    scale = np.array([part(r[0], "s", 4) == 0 for r in rows])
    word, doc = words(texts)
    kinds, n_docs = np.unique(np.unique(np.stack((word.view(np.int64), doc.astype(np.int64)), 1), axis=0)[:, 0].view(np.uint64), return_counts=True)
    once, twice = ((n_docs == k).sum() for k in (1, 2))
    tables = np.floor(n_docs ** (once / max(once + 2 * twice, 1)) * 1024) / 1024
    for limit in (1.0, 2.0, 3.0, 4.0):
        toxicity.Model.COMMON = limit
        z = {f: np.zeros(len(y)) for f in FORMS}
        for k in range(5):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            few = np.concatenate([train[y[train] == c][: toxicity.SAMPLE] for c in (1, 0)])
            learn, fit = few[~scale[few]], few[scale[few]]
            before, word, doc = toxicity._pairs([texts[i] for i in learn])
            pairs = np.unique(np.stack((y[learn][doc].astype(np.int64), before.view(np.int64), word.view(np.int64)), 1), axis=0)
            vocabulary, at = np.unique(pairs[:, 2].view(np.uint64), return_inverse=True)
            follows = np.stack([np.bincount(at[pairs[:, 0] == c], minlength=len(vocabulary)).astype(float) for c in (0, 1)])
            model = toxicity.Model(vocabulary, follows, tables[np.searchsorted(kinds, vocabulary)], tables.sum())
            x, there = (model.inputs([texts[i] for i in some])[0] for some in (fit, test))
            prior = np.log(y[train].sum() / (1 - y[train]).sum())
            for form, columns in FORMS.items():
                used = np.isin(np.arange(4), columns)
                model.fit_scale(x * used, y[fit], prior)
                z[form][test] = (there * used - model.middle) / model.spread @ model.scale[:4] + model.scale[4] + prior
        for form, s in z.items():
            right, more = ((s > 0) & (y == 1)).sum(), loss(y, s) - loss(y, z["all"])
            print(f"COMMON {limit:.0f}, {form}: AUC {auc(y, s):.4f}, precision {right}/{(s > 0).sum()}, recall {right}/{y.sum()}, log loss {loss(y, s).mean():.4f}, against all {more.mean():+.4f} +- {more.std() / len(y) ** 0.5:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
