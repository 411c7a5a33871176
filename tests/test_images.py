import numpy as np

from framelode.operators import images


def frames(spark, stack, **more):
    rows = [(i, a.shape[0], a.shape[1], a.astype(np.uint8).tobytes(), *(m[i].astype(np.uint8).tobytes() for m in more.values())) for i, a in enumerate(stack)]
    return spark.createDataFrame(rows, "frame int, height int, width int, pixels binary" + "".join(f", {k} binary" for k in more))


def test_dilation_grows_a_cross(spark):
    a = np.zeros((7, 9))
    a[3, 4] = a[0, 0] = 200
    for times, size in ((0, 3), (1, 3), (2, 3), (1, 5)):
        got = np.frombuffer(images.dilated_masks(frames(spark, [a]), times, size, 100).first().pixels, np.uint8).reshape(7, 9)
        want = np.zeros((7, 9), bool)
        for y, x in ((3, 4), (0, 0)):
            for v in range(7):
                for u in range(9):
                    dy, dx = abs(v - y), abs(u - x)
                    want[v, u] |= dy + dx <= times if size == 3 else times > 0 and (dy == 0 and dx <= 2 or dx == 0 and dy <= 2)
        assert ((got > 0) == want).all()


def test_equal_frames_are_alike_and_damage_shows(spark):
    a = np.full((32, 32), 100.0)
    b, m = a.copy(), np.zeros((32, 32))
    b[14:18, 14:18], m[14:18, 14:18] = 0, 255
    got = {r.frame: r for r in images.compared(frames(spark, [a, a], candidate=[a, b], mask=[np.zeros((32, 32)), m])).collect()}
    assert got[0].ssim == 1 and got[0].mae == 0 and got[0].mask_ssim is None
    assert got[1].mask_mae == 100 and got[1].mask_ssim < got[1].ssim < 1


def test_blur_keeps_flat_frames_and_pads_repeat_edges(spark):
    a = np.arange(15.0).reshape(3, 5)
    flat = images.soft_masks(frames(spark, [np.full((16, 16), 7.0)]), 5, 1.0).first()
    assert set(flat.pixels) == {7}
    wide = np.frombuffer(images.padded(frames(spark, [a]), 4).first().pixels, np.uint8).reshape(4, 8)
    assert (wide == np.pad(a, ((0, 1), (0, 3)), mode="edge")).all()
    assert list(images.cropped(frames(spark, [a]), 1, 1, 2, 2).first().pixels) == [6, 7, 11, 12]
