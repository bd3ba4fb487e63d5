"""Table schemas as DDL; missing values are NULL, masks are columns of their own."""

CAMERA = "seq STRING, frame INT, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, w2c ARRAY<DOUBLE>, c2w ARRAY<DOUBLE>"
FRAME = "seq STRING, frame INT, h INT, w INT, depth ARRAY<FLOAT>, mask ARRAY<FLOAT>, valid ARRAY<FLOAT>"
TRACK2D = "seq STRING, query_t INT, target_t INT, point_id BIGINT, x DOUBLE, y DOUBLE, occ_logit DOUBLE, dist_logit DOUBLE"
TRACK_OBS = "seq STRING, track_id BIGINT, t INT, x DOUBLE, y DOUBLE, z DOUBLE, visible BOOLEAN, invisible BOOLEAN, confidence DOUBLE"
STATIC_POINT = "seq STRING, point_id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, nx DOUBLE, ny DOUBLE, nz DOUBLE, r DOUBLE, g DOUBLE, b DOUBLE"
GAUSSIAN = "g_id BIGINT, part STRING, mean ARRAY<DOUBLE>, quat ARRAY<DOUBLE>, log_scale ARRAY<DOUBLE>, color_logit ARRAY<DOUBLE>, opacity_logit DOUBLE, coef_logit ARRAY<DOUBLE>"
MOTION_BASIS = "k INT, t INT, rot6 ARRAY<DOUBLE>, transl ARRAY<DOUBLE>"
KEYPOINT = "seq STRING, t INT, kp_id INT, x DOUBLE, y DOUBLE, visible BOOLEAN"
PRED_KEYPOINT = "seq STRING, src_t INT, dst_t INT, kp_id INT, x DOUBLE, y DOUBLE, z DOUBLE"
MEMORY = "video STRING, grp INT, elem_id BIGINT, key ARRAY<DOUBLE>, value ARRAY<DOUBLE>, use_count DOUBLE, life_count DOUBLE"
METRIC = "run STRING, step BIGINT, name STRING, value DOUBLE"
