"""All transforms."""

from .affine import Affine, AffinePoints, BaseAffine, Resize, Rotate, Scale, StackedAffine, Translate, affine_image_transform, affine_point_transform
from .base import (
    AbstractTransform, BaseTransform, BaseTransformSeeded, BatchTransform, KeyedTransform, PerChannelTransform, PerSampleTransform, Samples, Transform, UDFTransform,
)
from .channel import (
    ArgMax, BoxToSeg, FilterKeys, InstanceToSemantic, MapToSeq, OneHot, Permute, PopKeys, RenameKeys, SegToBox, SeqToMap, TensorOp, ToDevice, ToDeviceDtype,
    ToDtype, ToTensor, np_one_hot, one_hot,
)
from .compose import Compose, DoNothing, DropoutCompose, OneOf
from .intensity import NormMeanStd, NormMinMax, NormRange, NormZeroMeanUnitStd
from .intensity import ExponentialNoise, GaussianNoise, Noise
from .intensity import Clamp, GammaCorrection, InvertAmplitude, RandomBezierTransform
from .intensity import RandomAddValue, RandomScaleValue, RandomValuePerChannel
from .smoothing import GaussianSmoothing, KernelTransform, LocalPixelShuffle, RandomInOrOutpainting, RandomInpainting, RandomOutpainting
from .spatial import CenterCrop, Crop, Mirror, ProgressiveResize, RandomCrop, ResizeNative, Rot90, SizeStepScheduler, Zoom

__all__ = [n for n in dir() if not n.startswith("_")]
