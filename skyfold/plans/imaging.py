"""Calibration, flags, sky maps, their normal operator, and the tangent-plane Stokes imager."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.functions.expressions import Cx
from skyfold.plans.geometry import BROT, FREQ, FREQ2, R, ZEN

_g = lambda s: X.polar(f"{s}.amp", f"{s}.ph")
_f = _g("p") * _g("q").conj()
_v = Cx("v.re", "v.im") / _f
CAL = f"""select v.frame, v.a1, v.a2, case when ok then {_v.re} else 0e0 end re, case when ok then {_v.im} else 0e0 end im, case when ok then v.w*{_f.abs2()} else 0e0 end w
from (select v.*, p.amp pa, q.amp qa, p.amp*q.amp<>0e0 ok from vis v join gain p on p.a=v.a1 join gain q on q.a=v.a2) v join gain p on p.a=v.a1 join gain q on q.a=v.a2"""
#: Calibrated visibilities with rotated baselines: at most one row for each frame and baseline, made before any cross join.
ROWS = f"select c.frame, c.a1, c.a2, c.re, c.im, c.w, b.bx, b.by_, b.bz from ({CAL}) c join ({BROT}) b on c.frame=b.frame and c.a1=b.a1 and c.a2=b.a2"
EMPTY = ROWS.replace("c.re, c.im, c.w,", "c.re, c.im, case when c.frame=3 then 0e0 else c.w end w,", 1)
_b, _s = ("bx", "by_", "bz"), ("x", "y", "z")


def phases(rows: str, pix: str = "pix", freq: str = FREQ, carry: str = "") -> str:
    """Rows by pixels with the fringe phase."""
    return f"select frame, a1, a2, pix, re, im, w{carry}, {X.phase(_b, _s, freq)} ph, {freq} nu, x, y, z from ({rows}) rows_ cross join {pix}"


def dirty(rows: str = ROWS, pix: str = "pix", keys: str = "frame, pix") -> str:
    """Weighted adjoint over the sum of weights; 0 where no weight is left."""
    return f"select {keys}, case when sum(w)=0e0 then 0e0 else sum(w*(re*cos(ph)+im*sin(ph)))/sum(w) end dirty from ({phases(rows, pix)}) d group by {keys}"


def dirty_beam(freqs: tuple[str, ...] = (FREQ,)) -> str:
    """With the power beam of each channel; weights add up over channels."""
    sums = " union all ".join(f"select frame, pix, {f} nu, sum(w) sw, sum(w*(re*cos(ph)+im*sin(ph))) num from ({phases(ROWS, 'pix', f)}) c{i} group by frame, pix" for i, f in enumerate(freqs))
    # The beam belongs to a frame, a pixel and a channel, so it is evaluated on the sums and not on every row.
    return f"""select frame, pix, case when sum(sw)=0e0 then 0e0 else sum(num*{X.airy_power('mu', 'nu')})/sum(sw) end dirty
from (select s.frame, s.pix, nu, sw, num, p.x*zx+p.y*zy+p.z*zz mu from ({sums}) s join pix p on p.pix=s.pix join ({ZEN}) zen on s.frame=zen.frame) g group by frame, pix"""


def mfs() -> str:
    both = " union all ".join(f"select * from ({phases(ROWS, 'pix', f)}) c{i}" for i, f in enumerate((FREQ, FREQ2)))
    return f"select frame, pix, case when sum(w)=0e0 then 0e0 else sum(w*(re*cos(ph)+im*sin(ph)))/sum(w) end dirty from ({both}) q group by frame, pix"


DIRTY = dirty()
#: Maps meet the rows of their frame before a phase is taken, so what has no map is never made.
FORWARD = f"select frame, a1, a2, sum(val*cos(ph)) re, sum(val*sin(ph)) im from (select h.frame, a1, a2, val, {X.phase(_b, _s, FREQ)} ph from ({ROWS}) h join maps48 m on m.frame=h.frame join pix2 p on p.pix=m.pix) r group by frame, a1, a2"
_small = f"select frame, a1, a2, w, pix, {X.phase(_b, _s, FREQ)} ph from ({ROWS}) t1 cross join pix2"


def hessian(x: str) -> str:
    """H x for maps x(frame, pix, val): forward, weight, adjoint; two chained sums over one phase table."""
    fwd = f"select k.frame, k.a1, k.a2, sum(m.val*cos(ph)) re, sum(m.val*sin(ph)) im from ({_small}) k join ({x}) m on m.frame=k.frame and m.pix=k.pix group by k.frame, k.a1, k.a2"
    return f"select k.frame, k.pix, sum(k.w*(f.re*cos(k.ph)+f.im*sin(k.ph))) val from ({_small}) k join ({fwd}) f on f.frame=k.frame and f.a1=k.a1 and f.a2=k.a2 group by k.frame, k.pix"


ETA = "1e-2"
_B = f"select frame, pix, sum(w*(re*cos(ph)+im*sin(ph))) val from ({phases(ROWS, 'pix2')}) q group by frame, pix"
_L = f"select frame, {ETA}*sum(w) lam from ({ROWS}) q group by frame"


def _cg_steps(n: int) -> str:
    """Plain conjugate gradients on (H + lambda) x = b, unrolled: n steps from x = 0."""
    x = f"select frame, pix, 0e0 x, val r, val p from ({_B}) b0"
    for i in range(n):
        hp = hessian(f"select frame, pix, p val from s{i}")
        x = f"""s{i} as ({x}), h{i} as (select h.frame, h.pix, h.val+l.lam*s.p hp from ({hp}) h join s{i} s on s.frame=h.frame and s.pix=h.pix join ({_L}) l on l.frame=h.frame),
a{i} as (select s.frame, sum(s.r*s.r) rr, sum(s.r*s.r)/sum(s.p*h.hp) alpha from s{i} s join h{i} h on h.frame=s.frame and h.pix=s.pix group by s.frame),
u{i} as (select s.frame, s.pix, s.x+a.alpha*s.p x, s.r-a.alpha*h.hp r, s.p, a.rr from s{i} s join h{i} h on h.frame=s.frame and h.pix=s.pix join a{i} a on a.frame=s.frame),
b{i} as (select frame, sum(r*r)/max(rr) beta from u{i} group by frame),
select u.frame, u.pix, u.x, u.r, u.r+b.beta*u.p p from u{i} u join b{i} b on b.frame=u.frame"""
        head, _, tail = x.rpartition(",\nselect")
        x = f"select{tail}"
        steps.append(head)
    return x


steps: list[str] = []


def cg(n: int) -> str:
    steps.clear()
    last = _cg_steps(n)
    return f"with {', '.join(steps)}, done as ({last}) select frame, pix, {R('x', 6)} x, {R('r', 4)} r from done"


CORR = """select l_orderkey k, l_linenumber c, l_discount*1e0 re00, l_tax*1e0 im00, l_discount-3e-2 re01, l_tax*5e-1 im01, l_tax-2e-2 re10, l_discount*3e-1 im10, l_discount*7e-1 re11, l_tax-1e-2 im11,
 l_quantity*1e0 w00, l_quantity+1e0 w01, l_quantity+2e0 w10, l_quantity*2e0 w11, l_returnflag='R' f from lineitem"""
_V = [Cx(f"re{i}", f"im{i}") for i in ("00", "01", "10", "11")]
_W = [f"w{i}" for i in ("00", "01", "10", "11")]
_P = [Cx("(1e0+l*1e-2)", "1e-1"), Cx("5e-2", "(-2e-2)"), Cx("(-3e-2)", "4e-2"), Cx("9e-1", "(l*2e-2)")]
_Q = [Cx("95e-2", "(-1e-1)"), Cx("2e-2", "3e-2"), Cx("1e-2", "(-5e-2)"), Cx("(1e0-l*1e-2)", "2e-1")]


def _stokes(v: list[Cx], circular: bool) -> str:
    return ", ".join(f"{R(z.re, 9)} {n.lower()}_re, {R(z.im, 9)} {n.lower()}_im" for n, z in X.stokes(v, circular).items())


def _jones(v: list[Cx]) -> str:
    return f"select k, c, {_stokes(X.unjones(v, _P, _Q), False)}, {_stokes(X.unjones(v, _P, _Q), True).replace('_re', '_cre').replace('_im', '_cim')} from (select *, (k%24)*1e0 l from ({CORR}) q0) q"


def _jones_weights() -> str:
    each = [f"{R(w)} {feed[0].lower()}{n.lower()}" for feed in ("LINEAR", "CIRCULAR") for n, w in X.converter("WEIGHT", feed, True)(_W, _P, _Q).items()]
    return f"select k, c, {', '.join(each)} from (select *, (k%24)*1e0 l from ({CORR}) q0) q"


#: Unflagged rows of a Stokes-imaged frame: eight correlations on the zenith baselines.
_LM = """select v.frame, p.e-q.e u, p.n-q.n v_, p.u-q.u w_, v.re, v.im, v.w from vis v join ant p on p.a=v.a1 join ant q on q.a=v.a2"""
_GRID = "select a.a i, b.a j, (a.a-12)*2e-2 x, (b.a-12)*2e-2 y from ant a cross join ant b"
_lmph = f"(2e0*pi()*({FREQ}/{X.C})*(x*u+y*v_-w_*n1))"
LM = f"""select frame, i, j, sum(w*(si*cos({_lmph})-sq*sin({_lmph})))/max(n) stokes_i, sum(w*(di*cos({_lmph})-dq*sin({_lmph})))/max(n) stokes_q
from (select frame, i, j, x, y, -e/(sqrt(1e0-e)+1e0) n1, sqrt(1e0-e) n, u, v_, w_, w, (re+re*9e-1)*5e-1 si, (im+im*9e-1)*5e-1 sq, (re-re*9e-1)*5e-1 di, (im-im*9e-1)*5e-1 dq
from (select i, j, x, y, x*x+y*y e from ({_GRID}) g0) g cross join ({_LM}) r) k group by frame, i, j"""


def sql() -> dict[str, str | tuple[str, str]]:
    dirty8 = f"{R('dirty')} dirty"
    centroid = f"""select frame, {R('sum(d*x)/sum(d)', 6)} x, {R('sum(d*y)/sum(d)', 6)} y, {R('sum(d*z)/sum(d)', 6)} z, count(*) n, {R('max(d)')} flux from (
 select d.frame, d.dirty d, p.x, p.y, p.z from ({DIRTY}) d join pix p on p.pix=d.pix join (select frame, pix from (select d.frame, d.pix, row_number() over (partition by d.frame order by round(d.dirty,10) desc, d.pix) k from ({DIRTY}) d) t where k=1) m on m.frame=d.frame join pix c on c.pix=m.pix
 where p.x*c.x+p.y*c.y+p.z*c.z>=cos(radians(3e1)) and d.dirty>0e0) q group by frame"""
    offset = f"""select frame, {R('(sxy_*syy-sy_*sxy)/(sxx*syy-sxy*sxy)', 7)} du, {R('(sy_*sxx-sxy_*sxy)/(sxx*syy-sxy*sxy)', 7)} dv from (
 select v.frame, sum(u*u) sxx, sum(u*v_) sxy, sum(v_*v_) syy, sum(u*im) sxy_, sum(v_*im) sy_ from (select v.frame, p.e-q.e u, p.n-q.n v_, v.im from vis v join ant p on p.a=v.a1 join ant q on q.a=v.a2) v group by v.frame) q"""
    return {
        "apply_inverse_gains": f"select frame, a1, a2, {R('re')} re, {R('im')} im, {R('w')} w from ({CAL}) q",
        "flag_dead": "select v.frame, v.a1, v.a2, p.amp=0e0 or q.amp=0e0 flag, case when p.amp=0e0 or q.amp=0e0 then 0e0 else v.w end w from vis v join gain p on p.a=v.a1 join gain q on q.a=v.a2",
        "flag_any_corr": "select l_orderkey k, count(*) n, max(case when l_returnflag='R' then 1 else 0 end)=1 flagged from lineitem group by l_orderkey",
        "scan_visibilities": "select frame, a1, a2, p.name name1, q.name name2, {} re, {} im, w, 'RR' pol from vis v join ant p on p.a=v.a1 join ant q on q.a=v.a2".format(R("re"), R("im")),
        "prepare_frames": f"select frame, a1, a2, {R('re')} re, {R('im')} im, {R('w')} w, {R('bx', 6)} bx, {R('by_', 6)} by_, {R('bz', 6)} bz from ({ROWS}) q",
        "prepared_meta": f"select count(distinct frame) ntime, {R('min(t)', 3)} t0, {R('max(t)', 3)} t1, cast(192 as bigint) npix from frames",
        "nframes_cap": f"select frame, a1, a2, {R('re')} re, {R('im')} im, {R('w')} w from ({CAL}) q where frame<5",
        "dft_adjoint": f"select frame, pix, {R('sum(re*cos(ph)+im*sin(ph))', 7)} re, {R('sum(im*cos(ph)-re*sin(ph))', 7)} im from ({phases(ROWS)}) q group by frame, pix",
        "dft_forward": f"select frame, a1, a2, {R('re', 6)} re, {R('im', 6)} im from ({FORWARD}) q",
        "dirty_map": f"select frame, pix, {dirty8} from ({DIRTY}) q",
        "dirty_map_beam": f"select frame, pix, {dirty8} from ({dirty_beam()}) q",
        "dirty_map_mfs": f"select frame, pix, {dirty8} from ({mfs()}) q",
        "dirty_map_empty_frame": f"select frame, pix, {dirty8} from ({dirty(EMPTY)}) q",
        "image_frame": f"select frame, pix, {dirty8} from ({dirty()}) q",
        "image_combined": f"select pix, {dirty8} from ({dirty(keys='pix')}) q",
        "imager": f"select q.frame, q.pix, {R('q.dirty')} dirty, {R('f.t', 3)} time_out from ({dirty_beam()}) q join frames f on f.frame=q.frame",
        "hessian_diag": f"select frame, pix, {R('sum(w)', 7)} diag from ({_small}) q group by frame, pix",
        "hessian_matvec": f"select frame, pix, {R('val', 5)} val from ({hessian('select * from maps48')}) q",
        "tikhonov_inputs": f"select d.frame, d.pix, {R('d.dirty')} dirty, {R('s.sw', 7)} sw, {R(f's.sw*{ETA}', 7)} lam from ({DIRTY}) d join (select frame, sum(w) sw from ({CAL}) c group by frame) s on s.frame=d.frame",
        "cg_step": cg(1), "cg_two_steps": cg(2),
        "stokes_linear": f"select k, c, {_stokes(_V, False)} from ({CORR}) q",
        "stokes_circular": f"select k, c, {_stokes(_V, True)} from ({CORR}) q",
        "stokes_weights": "select k, c, {}, {} from ({}) q".format(", ".join(f"{R(w)} l{n.lower()}" for n, w in X.stokes_weights(_W).items()), ", ".join(f"{R(w)} c{n.lower()}" for n, w in X.stokes_weights(_W, True).items()), CORR),
        "stokes_jones": _jones(_V), "stokes_jones_weights": _jones_weights(),
        "lm_dirty_stokes": f"select frame, i, j, {R('stokes_i')} stokes_i, {R('stokes_q')} stokes_q from ({LM}) q",
        "cube_writer": f"select s stokes, frame, i x, j y, cast(round(case when s='I' then stokes_i else stokes_q end,6) as double) val from ({LM}) q cross join (select 'I' s union all select 'Q' s) n",
        "cube_mean_ext": f"select s stokes, i x, j y, {R("avg(case when s='I' then stokes_i else stokes_q end)", 7)} cube_mean from ({LM}) q cross join (select 'I' s union all select 'Q' s) n group by s, i, j",
        "peak_pixel": f"select frame, pix, {dirty8} from (select frame, pix, dirty, row_number() over (partition by frame order by round(dirty,10) desc, pix) k from ({DIRTY}) q) r where k=1",
        "peak_centroid": centroid, "analytic_offset": offset,
        "map_writer": f"select frame, pix, {R('dirty', 6)} dirty from ({DIRTY}) q",
    }
