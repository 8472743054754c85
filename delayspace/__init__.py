"""Empirical dynamic modelling on Spark.

States are rebuilt from lagged columns, and forecasts, interaction coefficients and causal skill come from nearest
neighbours among them. See README.md for the operators.
"""

from .functions.args import flatten_to_string
from .functions.stats import compute_error
from .operators.ccm import ccm
from .operators.embed import embed
from .operators.multiview import multiview
from .operators.plotdata import plot_ccm, plot_obs_pred, plot_smap, plot_sweep
from .operators.simplex import panel_simplex, simplex
from .operators.smap import smap
from .operators.state import Result
from .operators.surrogate import surrogate_data
from .operators.sweeps import embed_dimension, predict_exclusion_radius, predict_interval, predict_nonlinear
from .sources.series import load, write_csv

__all__ = [
    "Result", "ccm", "compute_error", "embed", "embed_dimension", "flatten_to_string", "load", "multiview", "panel_simplex", "plot_ccm", "plot_obs_pred", "plot_smap", "plot_sweep",
    "predict_exclusion_radius", "predict_interval", "predict_nonlinear", "simplex", "smap", "surrogate_data", "write_csv",
]
