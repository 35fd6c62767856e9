"""The transforms as plain functions of samples, and the functions they are made of."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np

from . import operators as ops
from .functions.kernels import bezier_curve, interp1d
from .functions.matrix import (
    batched_eye, create_rotation, create_rotation_2d, create_rotation_3d, create_rotation_3d_0, create_rotation_3d_1, create_rotation_3d_2, create_scale,
    create_translation, deg_to_rad, expand_scalar_param, matrix_to_cartesian, matrix_to_homogeneous, orthogonal_inverse, parametrize_matrix, points_to_cartesian,
    points_to_homogeneous, revert_coordinate_order, unit_box,
)
from .functions.rng import check_scalar, combinations_all, reshape_list
from .operators.affine import affine_image_transform, affine_point_transform
from .operators.base import Samples
from .operators.channel import np_one_hot, one_hot
from .operators.intensity import add_value, clamp, gamma_correction, norm_mean_std, norm_min_max, norm_range, norm_zero_mean_unit_std, scale_by_value

#: The curve, and interpolation on it, of the Bezier transform.
bezier_3rd_order, interpolate_curve = bezier_curve, interp1d


def add_noise(s: Samples, noise_type: str, keys: Sequence[str] = ("data",), **params) -> Samples:
    return ops.Noise(noise_type, keys=keys, **params)(s)


def random_inversion(s: Samples, prob: float = 0.5, high: float = 1.0, low: float = 0.0, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.InvertAmplitude(prob, high, low, keys)(s)


def mirror(s: Samples, dims, keys: Sequence[str] = ("data",)) -> Samples:
    """Always, of exactly these dimensions."""
    out = s
    for d in [dims] if isinstance(dims, int) else dims:
        out = ops.Mirror(d, keys, prob=1.0)(out)
    return out


def rot90(s: Samples, k: int, dims: Sequence[int], keys: Sequence[str] = ("data",)) -> Samples:
    return ops.Rot90(dims, keys, num_rots=(k,), prob=1.0)(s)


def resize_native(s: Samples, size=None, scale_factor=None, mode: str = "nearest", align_corners=None, preserve_range: bool = False, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.ResizeNative(size, mode, align_corners, preserve_range, keys, scale_factor)(s)


def crop(s: Samples, corner: Sequence[int], size, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.Crop(corner, size, keys)(s)


def center_crop(s: Samples, size, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.CenterCrop(size, keys)(s)


def random_crop(s: Samples, size, dist=0, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.RandomCrop(size, dist, keys)(s)


def one_hot_batch(s: Samples, num_classes: int | None = None, dtype: str | None = None, keys: Sequence[str] = ("seg",)) -> Samples:
    return ops.OneHot(num_classes, keys, dtype)(s)


def box_to_seg(s: Samples, keys: Mapping[str, str], shape: Sequence[int], dtype: str = "long") -> Samples:
    return ops.BoxToSeg(keys, shape, dtype)(s)


def seg_to_box(s: Samples, keys: Mapping[str, str]) -> Samples:
    return ops.SegToBox(keys)(s)


def instance_to_semantic(s: Samples, keys: Mapping[str, str], cls_key: str) -> Samples:
    return ops.InstanceToSemantic(keys, cls_key)(s)


def pop_keys(s: Samples, keys: Callable[[str], bool] | Sequence[str], return_popped: bool = False):
    return ops.PopKeys(keys, return_popped).apply(s)


def filter_keys(s: Samples, keys: Callable[[str], bool] | Sequence[str], return_popped: bool = False):
    return ops.FilterKeys(keys, return_popped).apply(s)


def tensor_op(s: Samples, op_name: str, *args, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.TensorOp(op_name, *args, keys=keys)(s)


def to_device_dtype(s: Samples, dtype: str = "double", device: str = "cpu", keys: Sequence[str] = ("data",)) -> Samples:
    return ops.ToDeviceDtype(device, dtype, keys)(s)


def local_pixel_shuffle(s: Samples, n: int = -1, block_size=(0, 0, 0), rel_block_size=0.1, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.LocalPixelShuffle(n, keys, block_size, rel_block_size)(s)


def random_inpainting(s: Samples, n: int = 5, high: float = 1.0, low: float = 0.0, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.RandomInpainting(n, high, low, keys)(s)


def random_outpainting(s: Samples, high: float = 1.0, low: float = 0.0, keys: Sequence[str] = ("data",)) -> Samples:
    return ops.RandomOutpainting(1.0, high, low, keys)(s)


def torch_one_hot(labels: np.ndarray, num_classes: int | None = None) -> np.ndarray:
    """[N] to [N, K], in a new array."""
    return np_one_hot(np.asarray(labels), num_classes)


__all__ = [n for n in dir() if not n.startswith("_")]
