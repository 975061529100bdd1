"""A small labelled table of personal data, written by hand: what stands in tags is of that kind, all else is not.

It holds what patterns find as well as what they miss (numbers without a
country code, hosts without a dot, addresses of the newer kind, cards written
with dots), beside numbers that are none: dates, versions, prices, ranges,
codes. Names, numbers and hosts are made up or reserved for documentation.
"""

LABELLED = """
call me at <phone>+1 (212) 555-0147</phone> after six
you reach us under <phone>(242) 555-6226</phone> on weekdays
my number is <phone>555-0199</phone> and the door code is 4471
dial <phone>212-555-0162</phone> or <phone>212-555-0163</phone> for help
tel. <phone>(415) 555-2671</phone>
phone: <phone>+44 20 7946 0958</phone>
fax <phone>020 7946 0991</phone> attention Mary
mobile <phone>07700 900123</phone>
ring <phone>01632 960983</phone> before noon on 3 May 2019
Telefon <phone>030 1234567</phone> oder <phone>0171/2345678</phone>
Rufen Sie <phone>+49 30 901820</phone> an
Fax: <phone>089/636-48018</phone>
appelez le <phone>06 12 34 56 78</phone> le soir
tél. <phone>01 70 18 99 02</phone>
téléphone <phone>+33 1 70 18 99 02</phone>
llame al <phone>600 123 456</phone> hoy
teléfono <phone>91 123 45 67</phone>
móvil <phone>+34 600 123 456</phone>
text <phone>415.555.0132</phone> to stop
support <phone>1-800-555-0199</phone> is free
her numbers: <phone>+1-202-555-0173</phone>, <phone>+1-202-555-0128</phone>
the hotline <phone>(800) 555-0100</phone> closes at 18:00
<phone>+1 (843) 555-7672</phone> 4692571279950054
<phone>+1 (826) 555-4081</phone> <card>4111 1111 1111 1111</card>
write to <email>jane.roe@example.com</email> today
mail <email>j_doe+news@mail.example.org</email>, please
cron sends to <email>root@localhost</email> every night
forward it to <email>admin@mailhost</email> or <email>ops@intranet</email>
ask <email>info@example.co.uk</email> or call <phone>+44 20 7946 0321</phone>
E-Mail: <email>max.muster@beispiel.example</email>
courriel <email>anne@exemple.example</email>
correo <email>ana.perez@ejemplo.example</email>
contact <email>webmaster@server1</email> about it
backup goes to <email>backup@nas</email> and <email>build@jenkins</email>
send logs to <email>lee@devhost</email> now
from <email>lee99@example.net</email> at 09:41
server <ip>192.0.2.17</ip> is down
ping <ip>198.51.100.4</ip> 56 bytes
from <ip>203.0.113.9</ip> port 22
route via <ip>2001:db8::1</ip> and <ip>2001:db8:0:1::53</ip>
listen on <ip>fe80::1ff:fe23:4567:890a</ip> only
the host <ip>2001:db8:85a3:0:0:8a2e:370:7334</ip> answered
blocked <ip>2001:db8::ff00:42:8329</ip> after 5 tries
address <ip>10.0.0.1</ip>, mask <ip>255.255.255.0</ip>
card <card>4111 1111 1111 1111</card> expires 04/27
paid with <card>5500-0000-0000-0004</card> on 2020-01-31
charged <card>4111.1111.1111.1111</card> twice
Visa <card>4222222222222</card> declined
Karte <card>4012888888881881</card> gesperrt
carte <card>3782.822463.10005</card> refusée
tarjeta <card>6011.1111.1111.1117</card> perdida
amex <card>378282246310005</card>
number <card>5105.1051.0510.5100</card> is a test
in 1999 and 2004 there were 17 of them
the years 1998-2004, see pages 12-34
version 2.0. of the license
Version 3.
BY-NC 4.0.
release 10.4.2 fixes 31 bugs in 2.1.0
it cost 19.99 or 1,250.00 in total
at 12:30 on 12/31/1999 and at 7:45
dated 2021-03-04 and 04.03.2021
am 24. Dezember 2015 um 18 Uhr
le 14 juillet 1789 à 10 heures
el 12 de octubre de 1492 a las 9
ISBN 978-3-16-148410-0 and ISSN 2049-3630
order 9859476043669043 was shipped
tracking 6625883203433323 1142126282388588
reference 5927243074273351!!
id 7536784127813050 4845168114407329 listed
chapter 3 section 4.2 verse 16
rows 1 2 3 4 5 and 6
a total of 100000 or 10^6 items
1+1 is 2 and 3+4 is 7
C++ and g++ 11 compile it
follow @home and @work
meet @ noon
room 204, building 7, floor 12
zip 90210 and 10115
score 3-2 then 21-19
ratio 16:9 at 1920x1080 and 60 fps
5% of 20 kg, 3.5 m, 40 C
error 404 on line 1532
line 80: value 0x1F4 at 0041f9a2
sha 9f86d081884c7d65 of build 20190412
model A4-2000 part 12-3456-78
flight LH400 gate B22 seat 14C
highway 66 exit 21A
ports 8080 and 8443
MD5 5d41402abc4b2a76b9719d911017c592
population 8,336,817 in 2019
15th and 21st of the 19th century
2nd place, 3rd time, 4x faster
temperature -12.5 to +30.2
a b2b deal in q3 of fy2024
call 3 people at 5
write 2 letters on page 7
""".strip().splitlines()
