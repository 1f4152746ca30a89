"""Reversible column encoders: fit (one aggregation pass per kind) and apply
(one projection).

Numeric columns: min-max to [-1, 1], standardisation (population std), or
quantile-to-normal.  Categorical columns: sorted dictionary codes, then
big-endian bits or one-hot.  The fitted state is a handful of small tables;
dictionaries above ``DICT_COLLECT_MAX`` entries never reach the driver and are
applied by join instead of a literal map.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import (UNROLL_MAX, argmax, bit_width, bits_to_code, clip_code, code_to_bits,
                                code_to_onehot, literal_array)
from ..functions.normal import from_uniform, normal_cdf, with_normal, with_uniform
from ..spec import TableSpec
from .dictjoin import dictionary_join
from .quantiles import exact_quantiles
from .rank import global_rank

INTEGRAL_TYPES = {"tinyint", "smallint", "int", "bigint"}
_LARGEST = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}
#: dictionaries up to this size are collected and applied as literal maps
DICT_LITERAL_MAX = 1_000
#: dictionaries up to this size are collected (and broadcast when joined), as long as all of a table fit in the bytes
DICT_COLLECT_MAX = 100_000
DICT_COLLECT_BYTES = 64 << 20


def _clean(c: str) -> Column:
    """The value with NaN turned into null (so aggregates skip both)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def n_quantiles(n: int) -> int:
    return min(max(min(n // 30, 1000), 10), max(n, 1))


def _handle_zero(scale: float) -> float:
    return 1.0 if (scale is None or abs(scale) < 10 * np.finfo(np.float64).eps) else scale


# --------------------------------------------------------------------------- fit: numeric

def fit_numeric(df: DataFrame, cols, kind: str = "minmax", quantile_method: str = "exact",
                quantile_output: str = "normal") -> dict:
    """A7 / A8 / A9.  All columns in one aggregation; quantiles in a second."""
    cols = list(cols)
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = _clean(c)
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"),
                 F.stddev_pop(x).alias(f"sd{i}"), F.count(x).alias(f"n{i}")]
    r = df.agg(*aggs).first().asDict()
    params = {}
    for i, c in enumerate(cols):
        mn, mx, av, sd, n = r[f"mn{i}"], r[f"mx{i}"], r[f"av{i}"], r[f"sd{i}"], r[f"n{i}"]
        p = {"kind": kind, "n": int(n), "min": mn, "max": mx, "mean": av, "std": sd}
        if kind == "minmax":
            scale = 2.0 / _handle_zero((mx - mn) if mx is not None else None)
            p.update(scale=scale, offset=-1.0 - (mn if mn is not None else 0.0) * scale)
        elif kind == "standard":
            p.update(scale=_handle_zero(sd), mean=av if av is not None else 0.0)
        params[c] = p
    if kind == "quantile":
        if quantile_output not in ("normal", "uniform"):
            raise ValueError(f"unknown quantile output: {quantile_output}")
        for c in cols:
            params[c]["output"] = quantile_output
        _fit_quantiles(df, cols, params, quantile_method)
    return params


def _fit_quantiles(df, cols, params, method):
    probs = {}
    for c in cols:
        p = params[c]
        nq = n_quantiles(p["n"])
        p["references"] = np.linspace(0.0, 1.0, nq).tolist()
        if p["n"] == 0:
            p["quantiles"] = [0.0] * nq
        else:
            probs[c] = p["references"]
    if probs and method == "approx":
        aggs = [F.percentile_approx(_clean(c), literal_array([float(v) for v in probs[c]]), 10000)
                .alias(f"q{i}") for i, c in enumerate(probs)]
        r = df.agg(*aggs).first()
        for i, c in enumerate(probs):
            params[c]["quantiles"] = [float(v) for v in r[f"q{i}"]]
    elif probs:
        got = exact_quantiles(df, probs, {c: params[c]["n"] for c in probs})
        for c in probs:
            params[c]["quantiles"] = got[c]
    for c in cols:
        q = np.maximum.accumulate(np.asarray(params[c]["quantiles"], dtype=np.float64))
        params[c]["quantiles"] = q.tolist()


# --------------------------------------------------------------------------- fit: categorical

def unpivot_values(df: DataFrame, cols) -> DataFrame:
    """(col, value) pairs of the listed columns, values as strings, nulls dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.explode(pairs).alias("kv")).select("kv.col", "kv.value").where("value is not null")


def fit_dictionary(df: DataFrame, cols) -> tuple[dict, dict, dict]:
    """A3 + W2: sorted distinct values per column and their codes.

    Returns (sizes, small, large): ``small[col]`` is the sorted value list,
    ``large[col]`` a (value, code) DataFrame written to the checkpoint folder.
    """
    cols = list(cols)
    if not cols:
        return {}, {}, {}
    distinct = unpivot_values(df, cols).distinct().persist()
    found = distinct.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("b")).collect()
    sizes, room = {c: 0 for c in cols}, DICT_COLLECT_BYTES
    small_cols = [c for c in cols if c not in {r["col"] for r in found}]
    for r in sorted(found, key=lambda r: (r["n"], r["col"])):  # the small ones first, within one budget for all
        sizes[r["col"]] = int(r["n"])
        cost = r["b"] + 64 * r["n"]
        if r["n"] <= DICT_COLLECT_MAX and cost <= room:
            small_cols.append(r["col"])
            room -= cost
    small = {c: [] for c in small_cols}
    if small_cols:
        for r in distinct.where(F.col("col").isin(small_cols)).orderBy("col", "value").collect():
            small[r["col"]].append(r["value"])
    large = {}
    from ..session import materialise
    for c in cols:
        if c in small:
            continue
        ranked = global_rank(distinct.where(F.col("col") == c), ["value"], name="r")
        large[c] = materialise(ranked.select("value", (F.col("r") - 1).alias("code")), f"dict-{c}")
    distinct.unpersist()
    return sizes, small, large


# --------------------------------------------------------------------------- model

@dataclass
class EncoderModel:
    spec: TableSpec
    num_kind: str
    cat_kind: str
    num_params: dict
    sizes: dict
    small_dicts: dict
    large_dicts: dict = field(default_factory=dict)
    dtypes: dict = field(default_factory=dict)
    raw_columns: tuple = ()
    unknown: str = "default"  # default: code -1 (all bits 1 / last one-hot slot); keep: reserved bucket; error

    def domain(self, c: str) -> int:
        """Codes a categorical column can take (one more with a reserved bucket)."""
        return self.sizes[c] + (1 if self.unknown == "keep" else 0)

    def _finish_code(self, code: Column, c: str) -> Column:
        if self.unknown == "keep":
            return F.when(code < 0, F.lit(self.sizes[c])).otherwise(code).cast("long")
        if self.unknown == "error":
            return F.when(code < 0, F.raise_error(F.concat(F.lit(f"unseen or null value in {c}: "),
                                                           F.coalesce(F.col(c).cast("string"), F.lit("NULL")))))\
                .otherwise(code).cast("long")
        return code

    # ---- layout
    @property
    def layout(self) -> list[dict]:
        rows, off = [], 0
        for c in self.spec.num_cols:
            rows.append({"col": c, "kind": "num", "offset": off, "width": 1})
            off += 1
        for c in self.spec.cat_cols:
            n = self.domain(c)
            w = bit_width(n) if self.cat_kind == "bits" else max(n, 1)
            rows.append({"col": c, "kind": "cat", "offset": off, "width": w})
            off += w
        return rows

    @property
    def width(self) -> int:
        return sum(r["width"] for r in self.layout)

    def column_block(self, features: Column | str, col: str) -> Column:
        """The slice of the feature vector that encodes source column ``col``."""
        row = next(r for r in self.layout if r["col"] == col)
        f = F.col(features) if isinstance(features, str) else features
        return F.slice(f, row["offset"] + 1, row["width"])

    def layout_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.layout, "col string, kind string, offset long, width long")

    # ---- encode
    def _num_expr(self, c: str) -> Column:
        p = self.num_params[c]
        x = F.col(c).cast("double")
        if p["kind"] == "minmax":
            return x * F.lit(p["scale"]) + F.lit(p["offset"])
        if p["kind"] == "standard":
            return (x - F.lit(p["mean"])) / F.lit(p["scale"])
        return F.col(f"__q_{c}")  # added by _with_quantiles

    def code_expr(self, c: str) -> Column:
        """Dictionary code of column ``c`` (literal map path); -1 if unseen/null."""
        values = self.small_dicts[c]
        if not values:
            return self._finish_code(F.lit(-1).cast("long"), c)
        m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        return self._finish_code(F.coalesce(F.try_element_at(m, F.col(c).cast("string")), F.lit(-1)).cast("long"), c)

    def with_codes(self, df: DataFrame) -> DataFrame:
        """Adds ``__code_<col>`` for every categorical column."""
        out = df
        lit_cols = {}
        for c in self.spec.cat_cols:
            if c in self.small_dicts and len(self.small_dicts[c]) <= DICT_LITERAL_MAX:
                lit_cols[f"__code_{c}"] = self.code_expr(c)
            else:
                out = self._join_dict(out, c)
        return out.withColumns(lit_cols) if lit_cols else out

    def _join_dict(self, df: DataFrame, c: str) -> DataFrame:
        spark = df.sparkSession
        if c not in self.small_dicts:
            j = dictionary_join(df, F.col(c).cast("string"), self.large_dicts[c].select("value", "code"), "value", f"__c_{c}")
            code = self._finish_code(F.coalesce(F.col(f"__c_{c}"), F.lit(-1)).cast("long"), c)
            return j.withColumn(f"__code_{c}", code).drop(f"__c_{c}")
        # size proven within DICT_COLLECT_MAX and DICT_COLLECT_BYTES: broadcast
        d = F.broadcast(spark.createDataFrame(list(enumerate(self.small_dicts[c])), "code long, value string"))
        d = d.select(F.col("value").alias(f"__k_{c}"), F.col("code").alias(f"__c_{c}"))
        j = df.join(d, df[c].cast("string") == d[f"__k_{c}"], "left")
        code = self._finish_code(F.coalesce(F.col(f"__c_{c}"), F.lit(-1)).cast("long"), c)
        return j.withColumn(f"__code_{c}", code).drop(f"__k_{c}", f"__c_{c}")

    def _quantile_columns(self) -> dict:
        return {c: p for c, p in self.num_params.items() if p["kind"] == "quantile"}

    def _with_quantiles(self, df: DataFrame) -> DataFrame:
        """Adds ``__q_<col>`` for every quantile-encoded column, stage by stage."""
        own = self._quantile_columns()
        if not own:
            return df
        df = with_uniform(df, {f"__u_{c}": (c, np.asarray(p["quantiles"]), np.asarray(p["references"])) for c, p in own.items()})
        normal = [c for c, p in own.items() if p.get("output", "normal") == "normal"]
        if normal:
            df = with_normal(df, {f"__z_{c}": f"__u_{c}" for c in normal})
        return df.withColumns({f"__q_{c}": F.col(f"__z_{c}" if c in normal else f"__u_{c}") for c in own})

    def feature_exprs(self) -> list[Column]:
        parts = [F.array(*[self._num_expr(c).cast("float") for c in self.spec.num_cols])] \
            if self.spec.num_cols else []
        for row in self.layout:
            if row["kind"] != "cat":
                continue
            code = F.col(f"__code_{row['col']}")
            parts.append(code_to_bits(code, row["width"]) if self.cat_kind == "bits"
                         else code_to_onehot(code, row["width"]))
        return parts

    def encode(self, df: DataFrame, keep=(), features: str = "features") -> DataFrame:
        """One projection: ``keep`` columns + ``features ARRAY<FLOAT>``."""
        coded = self._with_quantiles(self.with_codes(df))
        parts = self.feature_exprs()
        feat = F.concat(*parts) if len(parts) > 1 else parts[0]
        return coded.select(*keep, feat.alias(features))

    def flatten(self, df: DataFrame, features: str = "features", keep=()) -> DataFrame:
        """Positional ``num_i`` / ``cat_i`` columns (``cat_i`` counts bits)."""
        a = len(self.spec.num_cols)
        cols = [F.col(features)[i].alias(f"num_{i}") for i in range(a)]
        cols += [F.col(features)[a + j].alias(f"cat_{j}") for j in range(self.width - a)]
        return df.select(*keep, *cols)

    # ---- decode
    def _num_inverse(self, c: str, y: Column, clip: bool = False) -> Column:
        p = self.num_params[c]
        y = y.cast("double")
        if p["kind"] == "minmax":
            x = (y - F.lit(p["offset"])) / F.lit(p["scale"])
        elif p["kind"] == "standard":
            x = y * F.lit(p["scale"]) + F.lit(p["mean"])
        else:
            x = from_uniform(F.col(f"__u_{c}"), np.asarray(p["quantiles"]), np.asarray(p["references"]))  # added by decode
        if clip and p.get("min") is not None:  # optional: keep decoded values inside the fitted range
            x = F.least(F.greatest(x, F.lit(float(p["min"]))), F.lit(float(p["max"])))
        dt = self.dtypes.get(c)
        if dt in INTEGRAL_TYPES:  # half-even to an integer: rint (exact), not a decimal round trip
            top = F.lit(_LARGEST[dt])
            least = -top - 1
            r = F.rint(x)
            return (F.when(F.isnan(r), None).when(r >= top.cast("double"), top).when(r <= least.cast("double"), least)
                    .otherwise(r.try_cast(dt))).cast(dt)
        return x.cast(dt) if dt else x

    def decoded_codes(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds raw decoded codes ``__raw_<col>`` (before clipping)."""
        cols = {}
        for row in self.layout:
            if row["kind"] != "cat":
                continue
            if self.cat_kind == "bits" and row["width"] <= UNROLL_MAX:  # index the vector, no slice copies
                code = bits_to_code([F.col(features)[row["offset"] + j] for j in range(row["width"])])
            else:
                block = F.slice(F.col(features), row["offset"] + 1, row["width"])
                code = bits_to_code(block, row["width"]) if self.cat_kind == "bits" else argmax(block)
            cols[f"__raw_{row['col']}"] = code
        return df.withColumns(cols) if cols else df

    def valid_predicate(self) -> Column:
        """Every decoded code inside its dictionary domain."""
        cond = F.lit(True)
        for c in self.spec.cat_cols:
            code = F.col(f"__raw_{c}")
            cond = cond & (code >= 0) & (code < self.domain(c))
        return cond

    def decode(self, df: DataFrame, features: str = "features", keep=(),
               on_invalid: str = "clip", clip_numeric: bool = False) -> DataFrame:
        """Inverse of :meth:`encode`; columns come back in source order and type.

        ``on_invalid='clip'`` clips out-of-domain codes (the default path);
        ``'reject'`` drops rows with any out-of-domain code.  Numerics are not
        clipped (min-max decode can leave the fitted range) unless
        ``clip_numeric``.
        """
        d = self.decoded_codes(df, features)
        if on_invalid == "reject":
            d = d.where(self.valid_predicate())
        layout = {r["col"]: r for r in self.layout}
        out = {}
        uniform = {f"__u_{c}": F.col(features)[layout[c]["offset"]].cast("double") for c in self._quantile_columns()}
        if uniform:
            d = d.withColumns(uniform)
            d = d.withColumns({f"__u_{c}": normal_cdf(F.col(f"__u_{c}")) for c, p in self._quantile_columns().items()
                               if p.get("output", "normal") == "normal"})
        for c in self.spec.num_cols:
            out[c] = self._num_inverse(c, F.col(features)[layout[c]["offset"]], clip_numeric)
        joins = []
        for c in self.spec.cat_cols:
            code = clip_code(F.col(f"__raw_{c}"), max(self.domain(c), 1))
            if c in self.small_dicts and len(self.small_dicts[c]) <= DICT_LITERAL_MAX:
                vals = F.array(*[F.lit(v) for v in self.small_dicts[c]]) if self.small_dicts[c] \
                    else F.array(F.lit(None).cast("string"))
                v = F.try_element_at(vals, (code + 1).cast("int"))  # the reserved bucket decodes to null
                dt = self.dtypes.get(c)
                out[c] = v.cast(dt) if dt and dt != "string" else v
            else:
                out[f"__clip_{c}"] = code
                joins.append(c)
        d = d.withColumns(out)
        spark = df.sparkSession
        for c in joins:
            if c in self.small_dicts:
                dd = F.broadcast(spark.createDataFrame(list(enumerate(self.small_dicts[c])),
                                                       "code long, value string"))
                dd = dd.select(F.col("code").alias(f"__clip_{c}"), F.col("value").alias(f"__v_{c}"))
                d = d.join(dd, f"__clip_{c}", "left")
            else:
                d = dictionary_join(d, F.col(f"__clip_{c}"), self.large_dicts[c].select("value", "code"), "code", f"__v_{c}")
            dt = self.dtypes.get(c)
            d = d.withColumn(c, F.col(f"__v_{c}").cast(dt) if dt and dt != "string" else F.col(f"__v_{c}"))
        raw = [c for c in self.raw_columns if c in self.spec.feature_cols] or list(self.spec.feature_cols)
        return d.select(*keep, *raw)

    # ---- persistence (S4): small tables, never pickle
    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"num_cols": list(self.spec.num_cols), "cat_cols": list(self.spec.cat_cols),
                "label": self.spec.label, "key": list(self.spec.key), "num_kind": self.num_kind,
                "cat_kind": self.cat_kind, "sizes": self.sizes, "dtypes": self.dtypes,
                "raw_columns": list(self.raw_columns), "large": sorted(self.large_dicts), "unknown": self.unknown}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").json(os.path.join(path, "meta"))
        spark.createDataFrame([(c, json.dumps(p)) for c, p in self.num_params.items()] or [("", "{}")],
                              "col string, params string") \
            .write.mode("overwrite").parquet(os.path.join(path, "num_params"))
        rows = [(c, i, v) for c, vals in self.small_dicts.items() for i, v in enumerate(vals)]
        cat = spark.createDataFrame(rows, "col string, code long, value string")
        for c, d in self.large_dicts.items():
            cat = cat.unionByName(d.select(F.lit(c).alias("col"), "code", "value"))
        cat.write.mode("overwrite").parquet(os.path.join(path, "cat_dict"))
        self.layout_df(spark).write.mode("overwrite").parquet(os.path.join(path, "layout"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EncoderModel":
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        params = {r["col"]: json.loads(r["params"])
                  for r in spark.read.parquet(os.path.join(path, "num_params")).collect() if r["col"]}
        cat = spark.read.parquet(os.path.join(path, "cat_dict"))
        large = {c: cat.where(F.col("col") == c).select("code", "value") for c in meta["large"]}
        small = {c: [] for c in meta["cat_cols"] if c not in large}
        if small:
            for r in cat.where(F.col("col").isin(list(small))).orderBy("col", "code").collect():
                small[r["col"]].append(r["value"])
        spec = TableSpec(tuple(meta["num_cols"]), tuple(meta["cat_cols"]), meta["label"], tuple(meta["key"]))
        return EncoderModel(spec, meta["num_kind"], meta["cat_kind"], params, meta["sizes"], small,
                            large, meta["dtypes"], tuple(meta["raw_columns"]), meta.get("unknown", "default"))


def fit_encoder(df: DataFrame, spec: TableSpec, num_kind: str = "minmax", cat_kind: str = "bits",
                quantile_method: str = "exact", quantile_output: str = "normal",
                unknown: str = "default") -> EncoderModel:
    """``unknown``: how a category unseen at fit (or null) is encoded -- ``default``
    code -1 (all bits 1 / last one-hot slot), ``keep`` a reserved extra
    bucket (decoded to null), ``error`` fail the job."""
    if unknown not in ("default", "keep", "error"):
        raise ValueError(f"unknown 'unknown' mode: {unknown}")
    if num_kind not in ("minmax", "standard", "quantile"):
        raise ValueError(f"unknown numeric encoder: {num_kind}")
    if cat_kind not in ("bits", "onehot"):
        raise ValueError(f"unknown categorical encoder: {cat_kind}")
    params = fit_numeric(df, spec.num_cols, num_kind, quantile_method, quantile_output)
    sizes, small, large = fit_dictionary(df, spec.cat_cols)
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in spec.feature_cols}
    raw = tuple(c for c in df.columns if c in spec.feature_cols)
    return EncoderModel(spec, num_kind, cat_kind, params, sizes, small, large, dtypes, raw, unknown)
