"""From program relations to constraint rows: one rule an instruction kind, calls, external models, globals, clones.

``constraints`` rows are (ctype, src, dest, offs); ctype is 0 copy, 1 load, 2 store, 3 address-of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.plans.fixpoint import reachable
from quarry.plans.tables import ranked
from quarry.sources.logs import AGGREGATE_ID, INT_ID, NULL_ID, UNIVERSAL_ID

COPY, LOAD, STORE, ADDRESS = 0, 1, 2, 3
COLUMNS = ["ctype", "src", "dest", "offs"]


def row(ctype: int, src: Column | int, dest: Column | int, offs: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(ctype).alias("ctype"), lit(src).cast("int").alias("src"), lit(dest).cast("int").alias("dest"), lit(offs).cast("int").alias("offs"))


def from_instructions(instructions: DataFrame, return_base: int, object_base: int) -> DataFrame:
    """Rows of ``instructions`` (``inst, fn, op, dst, a, b, k, is_ptr, value_type, pointee``, and ``more`` of a phi).

    ``value_type`` is that of the value loaded, stored, taken out or put in: ptr, int, float or struct; ``pointee`` is what
    the address is declared to point to. ret: value to the function's return node. alloca: a fresh object. load: of a
    pointer; an int loaded through a pointer to pointers makes a load from the instruction's own id into the int node.
    store: of a pointer, or of the int node if an int goes where no int is declared; floats and structs make none. gep: a
    copy with a field offset. inttoptr: from the traced pointer b, or the int node if b is -1. cast: a copy; select: both
    values; phi: a, b and all of ``more``. extract/insert of pointers and ints go through the aggregate node. vaarg isn't
    supported and raises.
    """
    a, b, dst, ptr = F.col("a"), F.col("b"), F.col("dst"), F.col("is_ptr")
    none = F.array().cast("array<struct<ctype:int,src:int,dest:int,offs:int>>")
    op, kind = F.col("op"), F.col("value_type")
    moved = kind.isin("ptr", "int")
    no_ids = F.array().cast("array<int>")
    more = F.coalesce(F.col("more"), no_ids) if "more" in instructions.columns else no_ids
    rows = (
        F.when((op == "ret") & ptr, F.array(row(COPY, a, F.col("fn") + return_base)))
        .when(op == "alloca", F.array(row(ADDRESS, F.col("inst") + object_base, dst)))
        .when((op == "load") & (kind == "ptr"), F.array(row(LOAD, a, dst)))
        .when((op == "load") & (kind == "int") & (F.col("pointee") == "ptr"), F.array(row(LOAD, dst, INT_ID)))
        .when((op == "store") & (kind == "ptr"), F.array(row(STORE, a, b)))
        .when((op == "store") & (kind == "int") & (F.col("pointee") != "int"), F.array(row(STORE, INT_ID, b)))
        .when(op == "gep", F.array(row(COPY, a, dst, F.col("k"))))
        .when((op == "bitcast") & ptr, F.array(row(COPY, a, dst)))
        .when((op == "inttoptr"), F.array(row(COPY, F.when(b == -1, F.lit(INT_ID)).otherwise(b), dst)))
        .when((op == "select") & ptr, F.array(row(COPY, a, dst), row(COPY, b, dst)))
        .when((op == "phi") & ptr, F.transform(F.concat(F.array(a, b), more), lambda x: row(COPY, x, dst)))
        .when((op == "extract") & moved, F.array(row(COPY, AGGREGATE_ID, F.when(kind == "ptr", dst).otherwise(F.lit(INT_ID)))))
        .when((op == "insert") & moved, F.array(row(COPY, F.when(kind == "ptr", a).otherwise(F.lit(INT_ID)), AGGREGATE_ID)))
        .when(op == "vaarg", F.raise_error(F.lit("vaarg is not supported")).cast("array<struct<ctype:int,src:int,dest:int,offs:int>>"))
        .otherwise(none)
    )
    return instructions.select(F.explode(rows).alias("r")).select("r.*").distinct()


def typed(constraints: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a field for struct-typed copies, loads and stores (``fields``: ``type, n_fields``); addresses stay one."""
    out = constraints.join(fields, "type", "left")
    last = F.when(F.col("ctype") == ADDRESS, F.lit(0)).otherwise(F.coalesce("n_fields", F.lit(1)) - 1)
    out = out.withColumn("f", F.explode(F.sequence(F.lit(0), last)))
    return out.select("ctype", (F.col("src") + F.col("f")).alias("src"), (F.col("dest") + F.col("f")).alias("dest"), "offs")


def used_reachable(entries: DataFrame, edges: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks reached from ``entries`` over used blocks, and the unused blocks at which the walk stops."""
    inner = edges.join(used.select(F.col("bb").alias("dest")), "dest", "left_semi")
    start = entries.join(used.select(F.col("bb").alias("node")), "node", "left_semi")
    seen = reachable(start, inner)
    touched = seen.join(edges, F.col("node") == F.col("src")).select(F.col("dest").alias("node")).union(entries.select("node")).distinct()
    return seen, touched.join(used.select(F.col("bb").alias("node")), "node", "left_anti")


def direct_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Copies of a call's return, and of its arguments to parameters by position; extra ones go to the vararg node.

    ``calls``: ``call_id, fn, args, ret``; ``functions``: ``fn, params, ret_node, vararg`` (-1: none).
    """
    met = calls.join(functions, "fn")
    back = met.where("ret >= 0").select(F.lit(COPY).alias("ctype"), F.col("ret_node").alias("src"), F.col("ret").alias("dest"), F.lit(0).alias("offs"))
    each = met.select("params", "vararg", F.posexplode("args").alias("pos", "arg"))
    to = F.when(F.col("pos") < F.size("params"), F.get("params", F.col("pos"))).when(F.col("vararg") >= 0, F.col("vararg"))
    over = each.select(F.lit(COPY).alias("ctype"), F.col("arg").alias("src"), to.alias("dest"), F.lit(0).alias("offs")).where("dest is not null")
    return back.union(over).distinct()


def resolve_calls(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """``call_id, fn, how`` of each site (``call_id, callee, direct_fn``): direct, else profiled, else deferred (fn -1)."""
    met = sites.join(targets.select("call_id", F.col("fn").alias("seen")), "call_id", "left")
    how = F.when(F.col("direct_fn") >= 0, "direct").when(F.col("seen").isNotNull(), "profiled").otherwise("deferred")
    fn = F.when(F.col("direct_fn") >= 0, F.col("direct_fn")).otherwise(F.coalesce("seen", F.lit(-1)))
    return met.select("call_id", fn.alias("fn"), how.alias("how")).distinct()


# Library functions by model (name, model, first and second argument, named object).
EXACT_MODELS = [
    *((n, "alloc", -1, -1, None) for n in ("malloc", "valloc", "memalign", "mmap64", "calloc")),
    *((n, "realloc", 0, -1, None) for n in ("realloc",)),
    *((n, "noop", -1, -1, None) for n in ("free", "fclose", "pclose", "closedir", "qsort", "atoi", "printf", "strlen", "puts", "exit")),
    *((n, "alloc", -1, -1, None) for n in ("fopen", "tmpfile", "fopen64", "popen", "fdopen", "opendir", "fdopendir", "strdup")),
    *((n, "return_arg", 0, -1, None) for n in ("strchr", "strrchr", "stpcpy", "strcat", "strstr", "strncat", "strcpy", "strncpy", "strpbrk", "getcwd", "getwd", "mkdtemp", "memchr", "bindtextdomain", "fgets")),
    *((n, "return_arg", 1, -1, None) for n in ("localtime_r", "realpath")),
    *((n, "return_arg", 2, -1, None) for n in ("gcvt", "freopen")),
    *((n, "store_args", 0, 1, None) for n in ("strtol", "strtoul", "strtoll", "strtoull")),
    ("gettext", "return_arg_or_named", 0, -1, "gettext"),
    *((n, "return_named", -1, -1, o) for n, o in (("strtok", "strtok"), ("localtime", "datetime"), ("gmtime", "datetime"), ("textdomain", "textdomain"), ("getpwnam", "pwnam"), ("getgrnam", "grnam"), ("tigetstr", "terminfo"), ("tparm", "terminfo"), ("strerror", "clib"), ("gai_strerror", "clib"), ("getlocale", "locale"), ("setlocale", "locale"), ("nl_langinfo", "locale"), ("__errno_location", "errno"), ("getenv", "env"), ("__ctype_b_loc", "ctype"))),
    ("pthread_create", "thread", 3, -1, None),
]
# Patterns, tried in this order on names without an exact model.
PATTERN_MODELS = [(n, "noop") for n in ("llvm.memset", "llvm.bswap", "llvm.expect", "llvm.pow")] + [(n, "memcpy") for n in ("llvm.memcpy", "llvm.memmove", "memmove")]


def find_models(names: DataFrame, noop_names: DataFrame | None = None) -> DataFrame:
    """``name, model, p0, p1, named``: exact model, else the first pattern in the name, else unknown.

    ``noop_names`` (``name``) adds functions without effect; the exact table has a few of them only.
    """
    exact = names.sparkSession.createDataFrame(EXACT_MODELS, "name string, model string, p0 int, p1 int, named string")
    if noop_names is not None:
        extra = noop_names.join(exact, "name", "left_anti").select("name", F.lit("noop").alias("model"), F.lit(-1).alias("p0"), F.lit(-1).alias("p1"), F.lit(None).cast("string").alias("named"))
        exact = exact.union(extra.distinct())
    by_pattern = F.lit("unknown")
    for pattern, model in reversed(PATTERN_MODELS):
        by_pattern = F.when(F.contains(F.col("name"), F.lit(pattern)), model).otherwise(by_pattern)
    met = names.select("name").distinct().join(exact, "name", "left")
    return met.select("name", F.coalesce("model", by_pattern).alias("model"), F.coalesce("p0", F.lit(-1)).alias("p0"), F.coalesce("p1", F.lit(-1)).alias("p1"), "named")


#: Phony ids that a call has: three for each field of a copied struct.
MOST_FIELDS = 8


def external_calls(calls: DataFrame, models: DataFrame, named_base: int, object_base: int, phony_base: int, thread_params: DataFrame | None = None) -> DataFrame:
    """Rows of calls (``call_id, name, args, ret``, ret -1: no pointer) to external functions by their model.

    ``n_fields`` of a call, where there is such a column, is the number of fields of the largest struct type that a copied
    block is used as (0: none); more than ``MOST_FIELDS`` raises. ``thread_params`` (``callee, param``) has the first
    parameter of the functions that a thread may start with; of other start functions nothing is known.
    """
    met = calls.join(models, "name")
    if "n_fields" not in calls.columns:
        met = met.withColumn("n_fields", F.lit(0))
    arg = lambda p: F.get(F.col("args"), p)
    if thread_params is None:
        met = met.withColumn("param", F.lit(None).cast("int"))
    else:
        started = thread_params.select(F.col("callee").alias("_start"), "param")
        met = met.join(started, (F.col("model") == "thread") & (arg(2) == F.col("_start")), "left").drop("_start")
    ret, model = F.col("ret"), F.col("model")
    has = ret >= 0
    # A named object is one node for all calls: its name's place in the sorted list of names.
    names = sorted({m[4] for m in EXACT_MODELS if m[4]})
    named = F.lit(named_base) + F.array_position(F.array(*map(F.lit, names)), F.coalesce("named", F.lit(""))).cast("int")
    none = F.array().cast("array<struct<ctype:int,src:int,dest:int,offs:int>>")
    # Whatever an unknown function gets or gives is loaded into the universal node.
    into_universal = F.transform(F.when(has, F.array_append("args", ret)).otherwise(F.col("args")), lambda x: row(LOAD, x, UNIVERSAL_ID))
    fresh = F.col("call_id") + object_base
    phony = F.col("call_id") * (3 * MOST_FIELDS) + phony_base
    field = lambda i: F.array(row(COPY, arg(1), phony + 3 * i + 1, i), row(LOAD, phony + 3 * i + 1, phony + 3 * i), row(COPY, arg(0), phony + 3 * i + 2, i), row(STORE, phony + 3 * i, phony + 3 * i + 2))
    too_wide = F.raise_error(F.concat(F.lit(f"a struct of more than {MOST_FIELDS} fields is copied by call "), F.col("call_id").cast("string"))).cast("array<struct<ctype:int,src:int,dest:int,offs:int>>")
    rows = (
        F.when((model == "alloc") & has, F.array(row(ADDRESS, fresh, ret)))
        .when((model.isin("return_arg", "realloc")) & has, F.array(row(COPY, arg(F.col("p0")), ret)))
        .when((model == "return_named") & has, F.array(row(COPY, named, ret)))
        .when((model == "return_arg_or_named") & has, F.array(row(COPY, named, ret), row(COPY, arg(F.col("p0")), ret)))
        .when(model == "store_args", F.array(row(STORE, arg(F.col("p0")), arg(F.col("p1")))))
        .when((model == "memcpy") & (F.col("n_fields") > MOST_FIELDS), too_wide)
        .when((model == "memcpy") & (F.col("n_fields") > 0), F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_fields") - 1), field)))
        .when(model == "memcpy", F.array(row(LOAD, arg(1), phony), row(STORE, phony, arg(0))))
        .when((model == "thread") & F.col("param").isNotNull(), F.array(row(COPY, arg(F.col("p0")), F.col("param"))))
        .when(model == "unknown", into_universal)
        .otherwise(none)
    )
    return met.select(F.explode(rows).alias("r")).select("r.*").where("src is not null and dest is not null").distinct()


def constant_nodes(constants: DataFrame) -> DataFrame:
    """``const, node``: null and undef are the null node, numbers the int node, expressions their own (memoised) id."""
    kinds = constants.select("const", "kind").distinct()
    own = kinds.where(~F.col("kind").isin("null", "undef", "int", "float"))
    numbers = ranked(own.select("const").distinct(), ["const"], "node")
    own = own.join(numbers, "const").select("const", "kind", (F.col("node") + 99_999).alias("node"))
    fixed = kinds.where(F.col("kind").isin("null", "undef", "int", "float"))
    fixed = fixed.withColumn("node", F.when(F.col("kind").isin("null", "undef"), F.lit(NULL_ID)).otherwise(F.lit(INT_ID)))
    return fixed.unionByName(own).select("const", "node")


def global_rows(globals_: DataFrame, initialisers: DataFrame, object_base: int) -> DataFrame:
    """An object for each global, stores of its initialisers' leaves, and the universal node's own rows."""
    objects = globals_.select(F.lit(ADDRESS).alias("ctype"), (F.col("g") + object_base).alias("src"), F.col("g").alias("dest"), F.lit(0).alias("offs"))
    stores = initialisers.join(globals_, "g").select(F.lit(STORE).alias("ctype"), F.col("value").alias("src"), F.col("g").alias("dest"), F.lit(0).alias("offs"))
    u = UNIVERSAL_ID
    own = globals_.sparkSession.createDataFrame([(ADDRESS, u, u, 0), (STORE, u, u, 0)], "ctype int, src int, dest int, offs int")
    return objects.union(stores).union(own).distinct()


def clone_contexts(rows: DataFrame, contexts: DataFrame, shared_below: int, stride: int) -> DataFrame:
    """Callees' rows once a context: ids from ``shared_below`` on are moved to the context's own range.

    ``contexts``: ``ctx, fn``; ``rows``: constraints with ``fn``. Contexts of one component share a ``ctx``.
    """
    met = contexts.join(rows, "fn")
    moved = lambda c: F.when(F.col(c) < shared_below, F.col(c)).otherwise(F.col(c) + (F.col("ctx") + 1) * stride).alias(c)
    return met.select("ctype", moved("src"), moved("dest"), "offs").distinct()


def census(constraints: DataFrame) -> DataFrame:
    kind = F.when((F.col("ctype") == COPY) & (F.col("offs") != 0), "gep").when(F.col("ctype") == COPY, "copy").when(F.col("ctype") == LOAD, "load").when(F.col("ctype") == STORE, "store").otherwise("address")
    return constraints.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
