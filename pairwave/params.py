"""Parameters of a run: names, defaults, types, aliases, validation, option flags, parameter files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

from .functions.bins import Bins

#: Names of option flags.
OPTIONS = frozenset(
    """GGGCorrelation KKCorrelation KKKCorrelation NNCorrelation NNEstimator and-CF compute-HistN cute-box-rmin make-tree no-out-Hist
    out-HistZetaG out-m-HistZeta post-processing save-ra-dec stop xr1r2 Rcut/theta all-in-one bh86 sw94 edge-corrections-from-files
    make-info patch-with-all pre-processing read-mask statistics-histograms asymmetric behavior-ball no-one-ball kappa-constant-one all patch
    kappa-constant center-of-mass default-rsmooth fix-rsmooth no-check-two-bodies-eq-pos arfken check-eq-pos in-degrees only-pos
    pos-and-convergence pos-and-shear cute-box-fmt kappa smooth-pivot edge-corrections no-normalize-HistZeta header-info""".split()
) | {"one-ball", "two-balls"}
#: Search methods and the join that each asks for: on a sphere or in open space, or in a periodic box for counts.
METHODS = {"octree-sincos-omp": "open", "octree-ggg-omp": "open", "kdtree-omp": "open", "kdtree-box-omp": "box", "neighbor-boxes-omp": "box", "brute": "brute"}
#: Short names of parameters.
ALIASES = {"search": "searchMethod", "m": "mChebyshev", "in": "infile", "infmt": "infileformat", "ic": "iCatalogs", "root": "rootDir", "o": "outfile", "ofmt": "outfileformat", "log": "useLogHist", "bins": "sizeHistN", "range": "rangeN", "rmin": "rminHist", "n": "nbody", "lbox": "lengthBox", "opt": "options", "verb": "verbose"}


#: Options that name the statistic; without one a run has three-point multipoles.
STATISTICS = frozenset({"NNCorrelation", "NNEstimator", "KKCorrelation", "KKKCorrelation", "GGGCorrelation"})
#: Options that say what a run here does anyway: all pairs are exact, the FITS writer has the field, equal positions are taken.
ANYWAY = frozenset({"no-one-ball", "kappa", "no-check-two-bodies-eq-pos", "make-info"})
#: Parameters that Spark's own settings stand for; a run says so in its log.
BY_SPARK = ("numberThreads", "stepState")


@dataclass(frozen=True)
class Params:
    """Defaults are those of a unit-sphere run."""

    # Names and defaults of parameters.
    searchMethod: str = "octree-sincos-omp"
    mChebyshev: int = 7
    nsmooth: int = 8
    rsmooth: str = ""
    theta: float = 1.05
    usePeriodic: bool = False
    infile: str = ""
    infileformat: str = "columns-ascii"
    iCatalogs: str = "1"
    rootDir: str = "Output"
    outfile: str = ""
    outfileformat: str = "columns-ascii"
    thetaL: float = 1.279928
    thetaR: float = 1.861664
    phiL: float = 1.280107
    phiR: float = 1.861869
    useLogHist: bool = True
    logHistBinsPD: int = 5
    sizeHistN: int = 20
    rangeN: float = 0.0633205
    rminHist: float = 0.00213811
    sizeHistPhi: int = 32
    histNNFileName: str = "histNN"
    histXi2pcfFileName: str = "histXi2pcf"
    histZetaFileName: str = "histZeta"
    suffixOutFiles: str = ""
    seed: int = 123
    testmodel: str = "unit-sphere-random"
    nbody: int = 262144
    lengthBox: float = 2.0
    preScript: str = ""
    posScript: str = ""
    stepState: int = 10000
    verbose: int = 1
    verbose_log: int = 1
    numberThreads: int = 16
    options: str = ""
    columns: str = "1,2,3,4"

    def __post_init__(self):
        self.validate()

    def has(self, option: str) -> bool:
        return option in self.flags

    @property
    def flags(self) -> frozenset[str]:
        return frozenset(o.strip() for o in self.options.split(",") if o.strip())

    @property
    def bins(self) -> Bins:
        if not self.useLogHist:
            return Bins(self.rminHist, self.rangeN, self.sizeHistN, "linear")
        return Bins(self.rminHist, self.rangeN, self.sizeHistN) if self.rminHist > 0 else Bins(0.0, self.rangeN, self.sizeHistN, "decade", self.logHistBinsPD)

    @property
    def by_spark(self) -> list[str]:
        """Parameters set to other than their defaults that Spark's settings stand for."""
        return [n for n in BY_SPARK if getattr(self, n) != FIELDS[n].default]

    @property
    def key(self) -> str:
        """The same for equal parameters."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True, indent=1)

    def validate(self) -> None:
        import math

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.searchMethod in METHODS, f"no such searchMethod: {self.searchMethod}; there are {', '.join(METHODS)}")
        need(not (unknown := self.flags - OPTIONS), f"no such options: {', '.join(sorted(unknown))}")
        need(self.mChebyshev + 1 >= 3, "mChebyshev must be 2 at least")
        need(self.mChebyshev + 1 <= self.sizeHistPhi, "sizeHistPhi must exceed mChebyshev")
        need(self.nsmooth >= 1, "nsmooth must be positive")
        need(self.theta >= 0, "theta must not be negative")
        need(0 <= self.thetaL <= self.thetaR <= math.pi, "thetaL and thetaR must be ordered within 0 to pi")
        need(0 <= self.phiL <= self.phiR <= 2 * math.pi, "phiL and phiR must be ordered within 0 to 2 pi")
        need(self.sizeHistN >= 2, "sizeHistN must be 2 at least")
        need(0 <= self.rminHist < self.rangeN, "rminHist must be less than rangeN and not negative")
        need(not self.useLogHist or self.rminHist > 0 or METHODS[self.searchMethod] == "box", "logarithmic bins need rminHist > 0")
        need(self.sizeHistPhi & (self.sizeHistPhi - 1) == 0, "sizeHistPhi must be a power of two")
        need(self.nbody >= 3, "nbody must be 3 at least")
        need(self.lengthBox > 0, "lengthBox must be positive")
        need(not {"bh86", "sw94"} <= self.flags, "choose one of bh86 and sw94")
        need(not self.flags & {"bh86", "sw94"} or "behavior-ball" in self.flags, "bh86 and sw94 are rules of behavior-ball")
        balls = self.flags & {"one-ball", "two-balls", "behavior-ball", "no-one-ball"}
        need(len(balls) <= 1, "choose one of one-ball, two-balls, behavior-ball and no-one-ball")
        need("two-balls" not in self.flags or "KKCorrelation" in self.flags or "NNCorrelation" in self.flags, "two-balls is for NNCorrelation and KKCorrelation")
        need("two-balls" not in self.flags or not self.usePeriodic and METHODS[self.searchMethod] == "open", "two-balls is for open space")
        need(METHODS[self.searchMethod] != "brute" or not self.flags & {"one-ball", "two-balls", "behavior-ball"}, "brute compares all points: it takes no cells")
        need(not {"check-eq-pos", "no-check-two-bodies-eq-pos"} <= self.flags, "choose one of check-eq-pos and no-check-two-bodies-eq-pos")
        need(not {"fix-rsmooth", "default-rsmooth"} <= self.flags, "choose one of fix-rsmooth and default-rsmooth")
        need(len(self.flags & STATISTICS) <= 1, f"choose one of {', '.join(sorted(STATISTICS))}")
        need(not self.flags & {"patch-with-all", "all"} or "patch" in self.flags, "patch-with-all and all need patch")
        need("Rcut/theta" not in self.flags or self.theta > 0, "Rcut/theta needs theta > 0")
        need("cute-box-rmin" not in self.flags or not self.useLogHist, "cute-box-rmin is for linear bins")
        need(not self.preScript or "pre-processing" in self.flags, "preScript needs the option pre-processing")
        need(not self.posScript or "post-processing" in self.flags, "posScript needs the option post-processing")
        numbers(self.iCatalogs)
        need(len(self.flags & {"only-pos", "pos-and-convergence", "pos-and-shear"}) <= 1, "choose one of only-pos, pos-and-convergence and pos-and-shear")

    def replace(self, **changes) -> Params:
        return from_dict(dataclasses.asdict(self) | changes)


FIELDS = {f.name: f for f in dataclasses.fields(Params)}


def _typed(name: str, value: object) -> object:
    kind = type(FIELDS[name].default)
    if kind is bool and isinstance(value, str):
        if value.strip().lower() in ("true", "t", "yes", "y", "1"):
            return True
        if value.strip().lower() in ("false", "f", "no", "n", "0"):
            return False
        raise ValueError(f"{name} is true or false, not {value}")
    if kind is str and isinstance(value, (list, tuple)):
        return ",".join(map(str, value))
    return kind(value.strip() if isinstance(value, str) and kind is not str else value)


def from_dict(values: dict) -> Params:
    """Parameters by name or alias; unknown names are an error."""
    got = {}
    for name, value in values.items():
        name = ALIASES.get(name, name)
        if name not in FIELDS:
            raise ValueError(f"no such parameter: {name}")
        got[name] = _typed(name, value)
    return Params(**got)


def parse_file(text: str) -> dict[str, str]:
    """name = value lines; # and % begin comments; a line without = is an error, as is a repeated name."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.split("#")[0].split("%")[0].strip()
        if not line:
            continue
        name, equal, value = line.partition("=")
        if not equal:
            raise ValueError(f"no = in the line: {line}")
        if name.strip() in out:
            raise ValueError(f"given twice: {name.strip()}")
        out[name.strip()] = value.strip().strip("\"'")
    return out


def numbers(text: str, kind: type = int) -> list:
    """A comma list of numbers; empty text is an empty list."""
    return [kind(x) for x in text.split(",") if x.strip()]
