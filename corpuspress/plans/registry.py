"""Registered algorithms, their options, and plans: validated trees that compress bytes and columns.

A plan's two directions are plain functions of bytes; on a DataFrame they run as
scalar Arrow functions, so filters and column pruning pass through them and a
chain is one evaluation.  ``@compressor`` adds algorithms of one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coders
from ..operators import grammar, lz, transforms
from ..operators.index import portions
from ..sources import generators
from .parser import Algo, UnassignedArgument, UnknownAlgorithm, UnknownOption, WrongKind, parse

REQUIRED = object()


@dataclass
class Spec:
    """kind: compressor, coder, generator or choice; options: name to default (an algorithm string for algorithm options)."""

    name: str
    kind: str
    options: dict[str, object]
    kinds: dict[str, str] = field(default_factory=dict)
    make: Callable | None = None
    doc: str = ""


SPECS: dict[tuple[str, str], Spec] = {}
#: Older names of options.
ALIASES = {("lfs_comp", "coder"): "coding_strat", ("lfs2", "coder"): "lfs2_lit_coder", ("lfs2bst", "coder"): "lfs2_lit_coder"}


def register(spec: Spec) -> None:
    SPECS[spec.kind, spec.name] = spec


def resolve(value: object, kind: str) -> tuple[Spec, dict[str, object]]:
    """The spec and the options of an algorithm, defaults filled in; nested algorithms become (spec, options) too."""
    if not isinstance(value, Algo):
        raise WrongKind(f"a {kind} is expected, not {value!r}")
    spec = SPECS.get((kind, value.name))
    if spec is None:
        raise UnknownAlgorithm(f"no {kind} is called {value.name}")
    names = list(spec.options)
    if len(value.args) > len(names):
        raise UnknownOption(f"{value.name} takes {len(names)} options")
    given = dict(zip(names, value.args))
    for k, v in value.named:
        k = ALIASES.get((value.name, k), k)
        if k not in spec.options:
            raise UnknownOption(f"{value.name} has no option {k}")
        if k in given:
            raise UnknownOption(f"{k} is given twice")
        given[k] = v
    out: dict[str, object] = {}
    for k, default in spec.options.items():
        if k not in given and default is REQUIRED:
            raise UnassignedArgument(f"{value.name} needs {k}")
        if k in spec.kinds:
            own = given.get(k, default)
            out[k] = resolve(parse(own) if isinstance(own, str) and k not in given else own, spec.kinds[k])
        else:
            own = given.get(k, default)
            if isinstance(own, Algo):
                if own.args or own.named:
                    raise WrongKind(f"{k} of {value.name} is a plain value")
                own = own.name
            out[k] = plain(own, default, k)
    return spec, out


def plain(value: object, default: object, name: str) -> object:
    if isinstance(default, bool):
        if value in (True, "true", "1"):
            return True
        if value in (False, "false", "0"):
            return False
        raise WrongKind(f"{name} is true or false")
    if isinstance(default, int) or (default is REQUIRED and isinstance(value, str) and value.isdigit()):
        try:
            return int(value)  # type: ignore[arg-type]
        except ValueError:
            raise WrongKind(f"{name} is a number") from None
    return value


def build(found: tuple[Spec, dict[str, object]]) -> object:
    spec, options = found
    return spec.make(**{k: build(v) if isinstance(v, tuple) else v for k, v in options.items()})


@dataclass
class Codec:
    """Two inverse functions of bytes, and the same for many texts at once."""

    forward: Callable[[bytes], bytes]
    backward: Callable[[bytes], bytes]
    forward_all: Callable[[list[bytes]], list[bytes]] | None = None
    backward_all: Callable[[list[bytes]], list[bytes]] | None = None

    def __post_init__(self) -> None:
        self.forward_all = self.forward_all or (lambda texts: [self.forward(b) for b in texts])
        self.backward_all = self.backward_all or (lambda texts: [self.backward(b) for b in texts])


def encode_all(data: bytes, coder) -> bytes:
    e = coder.encoder(data)
    e.lits(data)
    return e.done()


def decode_all(data: bytes, coder) -> bytes:
    return coder.decoder(data).rest()


def pair(forward: Callable, backward: Callable) -> Callable:
    """A maker of codecs whose functions share options."""
    return lambda **o: Codec(lambda b: forward(b, **o), lambda b: backward(b, **o))


def two_coders(lit, length) -> coders.Fixed:
    if lit.name in coders.GROUPS["consuming"]:
        raise WrongKind(f"{lit.name} holds literals back")
    if length.name not in coders.GROUPS["universal"]:
        raise WrongKind(f"{length.name} is no universal coder")
    return coders.Two(lit, length)


def lfs_pair(layers: int, coder, min_lrf: int) -> Codec:
    return Codec(lambda b: grammar.lfs(b, coder, min_lrf, layers), lambda b: grammar.unlfs(b, coder, min_lrf, layers))


def lfs_one(computing_strat, coding_strat, min_lrf) -> Codec:
    return lfs_pair(1, coding_strat, computing_strat if computing_strat != 2 else min_lrf)


def lfs_two(min_lrf, exact, lfs2_lit_coder, lfs2_len_coder) -> Codec:
    if exact:
        raise UnknownOption("exact=true is not supported")
    return lfs_pair(2, two_coders(lfs2_lit_coder, lfs2_len_coder), min_lrf)


def only(kind: str, name: str, make: Callable, **values: object) -> Callable:
    """A maker that takes an option only at the value given here."""

    def check(**options):
        for k, v in values.items():
            if options.pop(k) != v:
                raise UnknownOption(f"{k} of {name} is {v} only")
        return make(**options)

    return check


TRIES = ("ternary", "binary", "binarysorted", "cedar", "hash", "hash_plus", "rolling", "rolling_plus", "exthash", "compact_sparse_hash", "judy")
STRATEGIES = ("arrays", "heap", "max_lcp", "plcppeaks", "bheap", "plcp", "naive")
CODER = {"coder": "coder"}
#: Data structures of the same result: kind, name, options and their kinds.
STRUCTURES = (
    ("sa", "divsufsort", {}, {}), ("phi", "from_sa", {}, {}), ("plcp", "from_phi", {}, {}), ("lcp", "from_phi", {}, {}), ("lcp", "compressed_lcp", {"sa": "divsufsort"}, {"sa": "sa"}),
    ("isa", "from_sa", {}, {}), ("isa", "sparse_isa", {"sa": "divsufsort", "t": 3}, {"sa": "sa"}),
    *(("hash_function", n, {}, {}) for n in ("noop", "mixer", "vigna", "knuth")), *(("hash_manager", n, {}, {}) for n in ("pow", "prime", "direct", "noob")),
    *(("hash_prober", n, {}, {}) for n in ("linear", "quad", "gauss")), *(("hash_roll", n, {}, {}) for n in ("zbackup", "wordpack", "rk")),
    *(("trie", n, {}, {}) for n in TRIES if "hash" not in n and "rolling" not in n), *(("trie", n, {"load_factor": 30}, {}) for n in ("exthash", "compact_sparse_hash")),
    ("trie", "hash", {"hash_function": "mixer", "hash_prober": "linear", "hash_manager": "pow", "load_factor": 30}, {"hash_function": "hash_function", "hash_prober": "hash_prober", "hash_manager": "hash_manager"}),
    ("trie", "hash_plus", {"hash_function": "mixer", "hash_manager": "direct", "load_factor": 30}, {"hash_function": "hash_function", "hash_manager": "hash_manager"}),
    ("trie", "rolling", {"hash_roller": "zbackup", "hash_prober": "linear", "hash_manager": "prime", "hash_function": "noop", "load_factor": 30}, {"hash_roller": "hash_roll", "hash_function": "hash_function", "hash_prober": "hash_prober", "hash_manager": "hash_manager"}),
    ("trie", "rolling_plus", {"hash_roller": "zbackup", "hash_manager": "noob", "hash_function": "noop", "load_factor": 30}, {"hash_roller": "hash_roll", "hash_function": "hash_function", "hash_manager": "hash_manager"}),
    ("dec", "scan", {"scans": 6}, {}), ("dec", "compact", {}, {}), ("dec", "QueueListBuffer", {}, {}), ("dec", "MultimapListBuffer", {"lazy": 0}, {}), ("dec", "multimap", {"lazy": 0}, {}), ("dec", "queue_list", {}, {}),
    ("ipd", "std_unordered_map", {}, {}), ("ipd", "hash_map", {}, {}), ("ipd", "dynamic_size", {"ipd": "std_unordered_map"}, {"ipd": "ipd"}),
)
for _kind, _name, _options, _kinds in STRUCTURES:
    register(Spec(_name, _kind, _options, _kinds, lambda _name=_name, **_: _name))


def text_structures(compress: str, **_) -> str:
    if compress not in ("plain", "none", "delayed", "compressed"):
        raise UnknownOption(f"compress={compress} of textds is not known")
    return "textds"


register(Spec("textds", "textds", {"sa": "divsufsort", "phi": "from_sa", "plcp": "from_phi", "lcp": "from_phi", "isa": "from_sa", "compress": "delayed"}, {k: k for k in ("sa", "phi", "plcp", "lcp", "isa")}, text_structures))


def choice(kind: str, names: tuple[str, ...], **options) -> None:
    """Names that select among ways to the same result (or a strategy); they yield their name."""
    for name in names:
        register(Spec(name, kind, dict(options), {}, lambda name=name, **_: name))


for _name, _make in coders.CODERS.items():
    register(Spec(_name, "coder", {"kmer": 3} if _name == "sle" else {}, {}, _make, f"{_name} coder"))
choice("comp", STRATEGIES)
register(Spec("lfs_enocde_strat", "coder", {"lfs_lit_coder": "huff", "lfs_len_coder": "gamma"}, {"lfs_lit_coder": "coder", "lfs_len_coder": "coder"}, lambda lfs_lit_coder, lfs_len_coder: two_coders(lfs_lit_coder, lfs_len_coder), "literals by one coder, numbers by another"))


def array_code(name: str) -> Callable:
    def make(subseq: str) -> str:
        code = name if subseq == "optimal" else f"{name}_{subseq}"
        if code not in grammar.CODES:
            raise UnknownOption(f"subseq={subseq} of {name} is not supported")
        return code

    return make


#: Options of single array codes that have but one value here.
FIXED = {"succinct": {"dx_coder": "wavelet_tree"}, "range_fit": {"threshold": "none", "wt": False, "zero_min": False}}
for _name in grammar.ARRAYS:
    _fixed = FIXED.get(_name, {})
    register(Spec(_name, "d_coding", {"subseq": "optimal", **_fixed}, {}, only("d_coding", _name, array_code(_name), **_fixed)))
register(Spec("plain", "slp_coder", {}, {}, lambda: ("plain", "plain")))
register(Spec("sorted", "slp_coder", {"d_coding": "plain", "dump_json": False, "dump_json_file": "-"}, {"d_coding": "d_coding"}, only("slp_coder", "sorted", lambda d_coding, dump_json_file: ("sorted", d_coding), dump_json=False)))
for _name in ("st", "bst", "sim_st"):
    register(Spec(_name, "lfs_strat", {"min_lrf": 2}, {}, lambda min_lrf: min_lrf))
register(Spec("esa", "lfs_strat", {"min_lrf": 2, "textds": "textds"}, {"textds": "textds"}, lambda min_lrf, textds: min_lrf))
for _name in ("streaming", "buffering"):
    register(Spec(_name, "lz78u_strat", {"string_coder": "bit"}, {"string_coder": "coder"}, lambda string_coder: string_coder))

for _spec in (
    Spec("noop", "compressor", {"mode": "stream", "debug": False}, {}, lambda **_: Codec(bytes, bytes), "the text as it is"),
    Spec("rle", "compressor", {"offset": 0}, {}, pair(transforms.rle, transforms.unrle), "run lengths"),
    Spec("mtf", "compressor", {}, {}, pair(transforms.mtf, transforms.unmtf), "move to front"),
    Spec("bwt", "compressor", {"textds": "textds"}, {"textds": "textds"}, lambda textds: Codec(transforms.bwt, transforms.unbwt), "Burrows-Wheeler transform"),
    Spec("escape", "compressor", {}, {}, pair(transforms.escape, transforms.unescape), "zeros escaped, a closing zero"),
    Spec("encode", "compressor", {"coder": REQUIRED}, CODER, pair(encode_all, decode_all), "each byte through a coder"),
    Spec("chain", "compressor", {"first": REQUIRED, "second": REQUIRED}, {"first": "compressor", "second": "compressor"}, lambda first, second: Codec(lambda b: second.forward(first.forward(b)), lambda b: first.backward(second.backward(b))), "one after the other"),
    Spec("lzss", "compressor", {"coder": "bit", "window": 16, "threshold": 3}, CODER, pair(lz.lzss, lz.unlzss), "sliding-window factors"),
    Spec("lzss_lcp", "compressor", {"coder": "bit", "textds": "textds", "threshold": 3}, {**CODER, "textds": "textds"}, lambda coder, textds, threshold: Codec(lambda b: lz.lzss_lcp(b, coder, threshold), lambda b: lz.unfactor(b, coder)), "exact earlier factors"),
    Spec("lcpcomp", "compressor", {"coder": "bit", "comp": "arrays", "dec": "scan", "textds": "textds", "threshold": 5, "flatten": True}, {**CODER, "comp": "comp", "dec": "dec", "textds": "textds"}, lambda coder, comp, dec, textds, threshold, flatten: Codec(lambda b: lz.lcpcomp(b, coder, comp, threshold, flatten), lambda b: lz.unfactor(b, coder)), "longest repeats first, references in both directions"),
    Spec("lz78", "compressor", {"coder": "bit", "lz78trie": "ternary", "dict_size": 0}, {**CODER, "lz78trie": "trie"}, lambda coder, lz78trie, dict_size: Codec(lambda b: lz.lz78(b, coder, dict_size), lambda b: lz.unlz78(b, coder, dict_size)), "growing phrases"),
    Spec("lzw", "compressor", {"coder": "bit", "lz78trie": "ternary", "dict_size": 0}, {**CODER, "lz78trie": "trie"}, lambda coder, lz78trie, dict_size: Codec(lambda b: lz.lzw(b, coder, dict_size), lambda b: lz.unlzw(b, coder, dict_size)), "growing phrases, codes only"),
    Spec("lz78u", "compressor", {"comp": "streaming", "coder": "bit", "threshold": 3}, {**CODER, "comp": "lz78u_strat"}, lambda comp, coder, threshold: Codec(lambda b: lz.lz78u(b, coder, threshold, comp), lambda b: lz.unlz78u(b, coder, threshold, comp)), "phrases that grow by suffix-tree edges"),
    Spec("repair", "compressor", {"coder": "bit", "max_rules": 0}, CODER, pair(grammar.repair, grammar.unrepair), "most frequent pairs"),
    Spec("esp", "compressor", {"slp_coder": "sorted", "ipd": "std_unordered_map"}, {"slp_coder": "slp_coder", "ipd": "ipd"}, lambda slp_coder, ipd: Codec(lambda b: grammar.esp(b, *slp_coder), lambda b: grammar.unesp(b, *slp_coder), lambda t: grammar.esp_all(t, *slp_coder)), "edit-sensitive parsing"),
    Spec("lfs_comp", "compressor", {"computing_strat": "esa", "coding_strat": "lfs_enocde_strat", "min_lrf": 2}, {"computing_strat": "lfs_strat", "coding_strat": "coder"}, lfs_one, "longest repeats substituted first"),
    Spec("lfs2", "compressor", {"min_lrf": 5, "exact": False, "lfs2_lit_coder": "huff", "lfs2_len_coder": "gamma"}, {"lfs2_lit_coder": "coder", "lfs2_len_coder": "coder"}, lfs_two, "the same in two layers"),
    Spec("lfs2bst", "compressor", {"min_lrf": 5, "exact": False, "lfs2_lit_coder": "huff", "lfs2_len_coder": "gamma"}, {"lfs2_lit_coder": "coder", "lfs2_len_coder": "coder"}, lfs_two, "the same in two layers"),
    Spec("fib", "generator", {"n": REQUIRED}, {}, generators.fibonacci, "Fibonacci word"),
    Spec("thue_morse", "generator", {"n": REQUIRED}, {}, generators.thue_morse, "Thue-Morse word"),
    Spec("run_rich", "generator", {"n": REQUIRED}, {}, generators.run_rich, "run-rich word"),
    Spec("random", "generator", {"length": REQUIRED, "seed": 0, "min": 48, "max": 57}, {}, generators.uniform, "uniform bytes"),
):
    register(_spec)


def compressor(name: str, doc: str = "", **options):
    """Register a class with ``encode`` and ``decode`` of bytes; ``options`` are its arguments with their defaults."""

    def add(cls):
        def make(**o):
            one = cls(**o)
            return Codec(one.encode, one.decode)

        register(Spec(name, "compressor", options, {}, make, doc))
        return cls

    return add


def codec(algorithm: str | Algo) -> Codec:
    return build(resolve(parse(algorithm) if isinstance(algorithm, str) else algorithm, "compressor"))


def generate(algorithm: str) -> bytes:
    return build(resolve(parse(algorithm), "generator"))


def canonical(algorithm: str) -> str:
    """The algorithm with every option written out."""

    def text(found: tuple[Spec, dict]) -> str:
        spec, options = found
        inner = ", ".join(f"{k}={text(v) if isinstance(v, tuple) else v}" for k, v in options.items())
        return spec.name + (f"({inner})" if inner else "")

    return text(resolve(parse(algorithm), "compressor"))


def _column(b: Column, make: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(batch: pa.Array) -> pa.Array:
        f, texts, out = make(), batch.to_pylist(), []
        for part in portions(texts):
            found = iter(f([t for t in texts[part] if t is not None]))
            out += [None if t is None else next(found) for t in texts[part]]
        return pa.array(out, pa.binary())

    return run(b.cast("binary"))


def compress(b: Column, algorithm: str) -> Column:
    """The compressed bytes of a binary or string column; null stays null."""
    codec(algorithm)
    return _column(b, lambda: codec(algorithm).forward_all)


def decompress(b: Column, algorithm: str) -> Column:
    codec(algorithm)
    return _column(b, lambda: codec(algorithm).backward_all)


def pack(b: Column, algorithm: str) -> Column:
    """Compressed bytes after a header that names the algorithm: ``id%payload``."""
    return F.concat(F.lit(f"{canonical(algorithm)}%").cast("binary"), compress(b, algorithm))


def unpack_bytes(data: bytes) -> bytes:
    at = data.find(b"%")
    if at < 0:
        raise ValueError("no algorithm before the data")
    return codec(data[:at].decode()).backward(data[at + 1 :])


def unpack(b: Column) -> Column:
    return _column(b, lambda: lambda blobs: [unpack_bytes(x) for x in blobs])


def list_algorithms(spark: SparkSession) -> DataFrame:
    rows = [(s.kind, s.name, ", ".join(k + ("" if v is REQUIRED else f"={v}") for k, v in s.options.items()), s.doc) for s in SPECS.values()]
    return spark.createDataFrame(rows, "kind string, name string, options string, doc string")


def combinations(most: int | None = None) -> list[str]:
    """Every compressor with every choice of its algorithm options, for the full test matrix."""
    from itertools import product

    flat = {"coder", *(k for k, *_ in STRUCTURES), "textds"}

    def variants(kind: str) -> list[str]:
        out = []
        for (k, name), s in SPECS.items():
            if k != kind or name == "chain":
                continue
            # Choices inside data structures and coders keep their defaults: their number multiplies, the results are the same.
            parts = [[f"{o}={v}" for v in variants(inner)] for o, inner in s.kinds.items()] if kind not in flat else []
            out += [f"{name}({', '.join(p)})" if p else name for p in product(*parts)]
        return out

    def valid(algorithm: str) -> bool:
        try:
            codec(algorithm)
        except WrongKind:  # coders that the compressor can't take
            return False
        return True

    return [a for a in variants("compressor") if valid(a)][:most]
