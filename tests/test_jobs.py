"""Jobs by tier: order, failure, cancelling, and being overtaken."""

import threading

from latticework.operators.jobs import Jobs


def test_jobs(spark):
    jobs = Jobs(spark)
    started, seen, tries = threading.Event(), [], []

    def slow(session, job):
        tries.append(len(tries))
        if len(tries) == 1:
            started.set()
            while True:  # until a more urgent job comes
                job.check()
                threading.Event().wait(0.02)
        seen.append("slow")
        return session.range(10).count()

    low = jobs.submit("low", "background", slow)
    assert started.wait(20)
    last = jobs.submit("last", "background", lambda s, j: seen.append("last"))
    gone = jobs.submit("gone", "user", lambda s, j: seen.append("gone"))
    # the user's job overtook; queued ones can be taken back, or have run
    taken = jobs.cancel(gone)
    urgent = jobs.submit("urgent", "interactive", lambda s, j: (j.report(1, 2, "half"), s.range(5).count())[1])
    bad = jobs.submit("bad", "user", lambda s, j: 1 // 0)
    for j in (low, last, urgent, bad, gone):
        assert j.done.wait(60)
    assert low.state == "done" and low.result == 10 and len(tries) == 2
    assert urgent.result == 5 and urgent.progress == [(1, 2, "half")]
    assert bad.state == "failed" and isinstance(bad.error, ZeroDivisionError)
    assert taken == (gone.state == "cancelled") and [x for x in seen if x != "gone"] == ["slow", "last"]
    assert not jobs.cancel(urgent)
    hold = threading.Event()

    def endless(session, job):
        hold.set()
        while True:
            job.check()
            threading.Event().wait(0.02)

    run = jobs.submit("endless", "user", endless)
    assert hold.wait(20) and jobs.cancel(run) and run.done.wait(20) and run.state == "cancelled"
    jobs.close()
