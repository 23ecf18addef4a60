"""The public names of the core in one place."""

from motespark.functions.diag import dependencies, handle_logging, ignore_logging, performance_report, quiet
from motespark.functions.imageproc import (
    bandpass,
    boxcar,
    convert_to_int,
    grey_dilation,
    grey_dilation_legacy,
    invert_image,
    legacy_bandpass,
    legacy_bandpass_fftw,
    local_maxima,
    lowpass,
    measure_noise,
    percentile_threshold,
    scale_to_gamut,
    scalefactor_to_gamut,
)
from motespark.functions.scalar import extract, fit_powerlaw, lazy_timestamp, random_walk, safe_exp, seconds, seconds_between, time_interval, timedelta_to_frame, timestamp
from motespark.functions.synth import SimulatedImage, draw_array, draw_cluster, draw_feature, draw_features_brightfield, draw_spots
from motespark.operators.assignment import SubnetOversizeError, UnknownLinkingError
from motespark.operators.brightfield import brightfield_batch, locate_brightfield_ring
from motespark.operators.filtering import bust_clusters, bust_ghosts, filter_clusters, filter_stubs, filter_tracks, mass_size_filter, strip_diagnostics, topn, verify_integrity
from motespark.operators.find_link import FindLinker, find_link, find_link_iter
from motespark.operators.linking import Linker, link, link_candidates, link_df_iter, link_frames, link_partial, link_stateful, reconnect, renumber
from motespark.operators.locate import batch, characterize, estimate_mass, estimate_size, locate, minmass_v03_change, minmass_v04_change, refine_com
from motespark.operators.motion import (
    compute_drift,
    diagonal_size,
    direction_corr,
    emsd,
    imsd,
    is_diffusive,
    is_localized,
    is_typical,
    min_rolling_theta_entropy,
    msd,
    relate_frames,
    subtract_drift,
    theta_entropy,
    vanhove,
    velocity_corr,
)
from motespark.operators.near import near_pairs, near_pairs_geo, points_in_regions
from motespark.operators.plotdata import annotate, density_profile, mass_ecc, mass_size, plot_displacements, plot_traj, scatter, subpx_bias
from motespark.operators.predict import ChannelPredict, DriftPredict, NearestVelocityPredict, NullPredict, instrumented, predictor
from motespark.operators.refine_lsq import dimer, dimer_global, refine_batch, refine_leastsq, tetramer, train_leastsq, trimer
from motespark.operators.regular_grid import to_regular_grid
from motespark.operators.rolling import rolling
from motespark.operators.spikes import flag_readings
from motespark.operators.static import cluster, cluster_iter, drop_close, pair_correlation_2d, pair_correlation_3d, proximity, where_close
from motespark.operators.uncertainty import static_error
from motespark.sources.frames import pixel_table, read_frames
from motespark.sources.framestore import FrameStore
from motespark.streaming.linker import link_stream

link_df, link_iter, refine, reconnect_traj_patch = link, link_frames, refine_com, reconnect

__all__ = [n for n in dir() if not n.startswith("_")]
