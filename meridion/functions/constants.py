"""Fixed values of the WGS84 ellipsoid, its authalic sphere, and the tolerances of the geometry rules."""

from __future__ import annotations

import math

EPS = 2.0**-52
PI, HALF_PI, TWO_PI = math.pi, math.pi / 2, 2 * math.pi
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
Q_POLE = (1 - E2) * (1 / (1 - E2) + math.atanh(E) / E)
AUTHALIC_RADIUS = SEMI_MAJOR * math.sqrt(Q_POLE / 2)
SURFACE = 2 * TWO_PI * AUTHALIC_RADIUS**2
RADIANS = 0.017453292519943295

AUTHALIC_CLAMP = 16 * EPS
MOLLWEIDE_CLAMP = 32 * EPS
POLE_FLOOR = 64 * EPS
ROTATION_TOLERANCE = 1e-12
HALF_TURN = 64 * EPS * PI
WINDING_TOLERANCE = 256 * EPS
SEAM_ANGLE = 1024 * EPS * PI
SEAM_PARAMETER = 128 * EPS
POLAR_DOMAIN = 512 * EPS * PI
POLAR_PARAMETER = 64 * EPS
